"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.functions import affect as AF
from newsgauge.functions import fixed_values as V
from newsgauge.functions import prompts as PR
from newsgauge.functions import text as TX
from newsgauge.functions import vectors as VE
from newsgauge.operators import classify as CL
from newsgauge.operators import clean as CN
from newsgauge.operators import evidence as EV
from newsgauge.operators import models as MO
from newsgauge.operators import retrieval as RE
from newsgauge.operators import scoring as SC
from newsgauge.operators import stats as ST
from newsgauge.plans import views
from newsgauge.session import new_path
from newsgauge.sources import matrix, sinks, tables
from newsgauge.streaming import incremental as IN
from newsgauge.streaming import retry as RT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(c: Column) -> Column:
    return F.array_join(c, ",")


# --- sources and sinks ---------------------------------------------------------------------

ARTICLES = T.StructType(
    [T.StructField("article_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("source", "lang", "title", "text", "label")]
)


def _articles_csv(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "articles-csv")
    sinks.sink_csv(views.articles(spark, sf_dir), path)
    return path


@query
def scan_csv(spark, sf_dir):
    return tables.scan_csv(spark, _articles_csv(spark, sf_dir), ARTICLES)


@query
def scan_csv_strings(spark, sf_dir):
    return tables.scan_csv_strings(spark, _articles_csv(spark, sf_dir), ARTICLES).select(
        "article_id", "source", "lang", "text"
    )


@query
def scan_parquet(spark, sf_dir):
    return tables.scan_parquet(spark, f"{sf_dir}/documents.parquet")


@query
def scan_labelled_files(spark, sf_dir):
    path = new_path(spark, "labelled")
    raw = views.articles(spark, sf_dir).where(F.col("label").isNotNull()).select(
        F.col("article_id").cast("string").alias("id"), "title", "text",
        F.concat_ws("_", "source", "label").alias("name"),
    )
    raw.write.partitionBy("name").csv(path, header=True, quote='"', escape='"', emptyValue="")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "text")])
    return tables.scan_labelled_files(spark, path, schema, name_pattern=r"/name=([^/]+)/[^/]+$")


@query
def sink_table(spark, sf_dir):
    path = new_path(spark, "profiles-csv")
    sinks.sink_csv(SC.affect_profile(views.task_replies(spark, sf_dir)), path)
    wanted = ["article_id", "vreg", "voc", *ST.EIREG, "ec"]
    fields = {f.name: f for f in tables.AFFECT_SCHEMA}
    # The order of the CSV columns.
    schema = T.StructType([fields[c] for c in wanted])
    return tables.scan_csv(spark, path, schema).withColumn("ec", joined(F.col("ec")))


@query
def sink_partitioned(spark, sf_dir):
    path = new_path(spark, "by-label")
    labelled = views.cleaned_articles(spark, sf_dir).where(F.col("label").isNotNull())
    sinks.sink_partitioned(labelled.select("article_id", "full_text", "source", "label"), path)
    return spark.read.parquet(path)


@query
def sink_vectors(spark, sf_dir):
    path = new_path(spark, "vectors")
    sinks.sink_vectors(views.vectors(spark, sf_dir), path)
    return spark.read.parquet(path).select(
        "article_id", F.size("embedding").alias("dims"),
        F.round(VE.norm(F.col("embedding")), 6).alias("norm"),
    )


@query
def sink_matrix(spark, sf_dir):
    path = new_path(spark, "matrix")
    matrix.sink_matrix(views.vectors(spark, sf_dir), path)
    return matrix.scan_matrix(spark, path).select(
        "row", "article_id", F.size("embedding").alias("dims"),
        F.round(VE.norm(F.col("embedding")), 6).alias("norm"),
    )


@query
def vector_check(spark, sf_dir):
    return RE.vector_check(views.vectors(spark, sf_dir))


@query
def resume_todo(spark, sf_dir):
    articles = views.documents(spark, sf_dir)
    done = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"))
    return IN.resume_todo(articles, done).select("article_id", "source")


class LengthScorer:
    """Stands in for a model: the reply depends on the prompt only."""

    def __call__(self, prompts):
        return [f"Score: 0.{len(p) % 97}" for p in prompts]


@query
def score_batch(spark, sf_dir):
    prompts = PR.prompt_fanout(views.cleaned_documents(spark, sf_dir))
    return SC.score_batch(prompts, LengthScorer)


@query
def score_with_kept_model(spark, sf_dir):
    prompts = PR.prompt_fanout(views.cleaned_documents(spark, sf_dir))
    return SC.score_with_kept_model(prompts, LengthScorer)


class LengthEmbedder:
    """Stands in for an embedding model that takes short prompts only."""

    def __call__(self, prompt):
        if len(prompt) > len(V.VREG_PROMPT) + 100:
            raise RuntimeError("context too long")
        return [float(len(prompt)), 1.0]


@query
def embed_batch(spark, sf_dir):
    inputs = PR.embedding_inputs(views.cleaned_documents(spark, sf_dir))
    return SC.embed_batch(inputs, LengthEmbedder).select(
        "article_id", F.size("embedding").alias("dims"),
        F.element_at("embedding", 1).cast("double").alias("first"), "status",
    )


@query
def stream_scores(spark, sf_dir):
    source, output, checkpoint = (new_path(spark, n) for n in ("incoming", "scores", "progress"))
    views.documents(spark, sf_dir).select("article_id", "title", "text").write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        IN.stream_scores(spark, source, output, checkpoint, LengthScorer)
    return spark.read.schema(SC.REPLY_SCHEMA).parquet(output)


@query
def stream_with_retry(spark, sf_dir):
    source, output, checkpoint = (new_path(spark, n) for n in ("incoming", "scores", "progress"))
    views.documents(spark, sf_dir).select("article_id", "title", "text").write.parquet(source)
    running = RT.stream_scores_with_retry(
        spark, source, output, checkpoint, LengthScorer, wait_ms=1000, every="1 second"
    )
    try:
        # Timers keep the query busy for ever; a batch without input means that all files are done.
        while not running.awaitTermination(1):
            done = running.lastProgress
            if done and not done["numInputRows"]:
                break
    finally:
        running.stop()
    return spark.read.schema(SC.REPLY_SCHEMA).parquet(output)


@query
def score_new(spark, sf_dir):
    output = new_path(spark, "scores")
    for _ in range(2):  # the second run finds nothing to do
        IN.score_new(spark, views.cleaned_documents(spark, sf_dir), output, LengthScorer)
    return IN.latest_replies(spark.read.schema(SC.REPLY_SCHEMA).parquet(output))


@query
def model_roundtrip(spark, sf_dir):
    affect = views.affect(spark, sf_dir)
    path = new_path(spark, "model")
    MO.save_model(MO.train_classifier(affect), path)
    return MO.classify_affect(MO.load_model(path), affect).select(
        "article_id", "label", "affect_pred", "affect_confidence"
    )


# --- cleaning ------------------------------------------------------------------------------


def _raw_articles(spark, sf_dir) -> DataFrame:
    """Articles with ``na`` for missing cells, and a mostly missing column."""
    a = views.articles(spark, sf_dir)
    note = F.when(F.col("article_id") % 5 == 0, F.col("source")).otherwise("na")
    return a.select(
        "article_id", "source", "title", F.coalesce("label", F.lit("na")).alias("label"),
        note.alias("note"),
    )


@query
def clean_sentinel(spark, sf_dir):
    return CN.clean_sentinel(_raw_articles(spark, sf_dir))


@query
def null_profile(spark, sf_dir):
    profile = CN.null_profile(CN.clean_sentinel(_raw_articles(spark, sf_dir)))
    return rounded(profile, 6, "null_pct")


@query
def drop_sparse_columns(spark, sf_dir):
    return CN.drop_sparse_columns(CN.clean_sentinel(_raw_articles(spark, sf_dir)))


@query
def drop_null_rows(spark, sf_dir):
    cleaned = CN.clean_sentinel(_raw_articles(spark, sf_dir))
    return CN.drop_null_rows(CN.drop_sparse_columns(cleaned))


@query
def drop_columns(spark, sf_dir):
    a = views.articles(spark, sf_dir)
    raw = a.withColumns({"id": F.col("article_id").cast("string"), "authors": F.col("source")})
    return CN.drop_columns(raw)


@query
def full_text(spark, sf_dir):
    return CN.add_full_text(views.documents(spark, sf_dir)).select("article_id", "full_text")


@query
def filter_short(spark, sf_dir):
    cleaned = CN.clean_articles(views.documents(spark, sf_dir))
    return cleaned.select("article_id", F.char_length("full_text").alias("chars"))


@query
def truncate_text(spark, sf_dir):
    a = views.documents(spark, sf_dir)
    sizes = {"text_350": ("text", 350), "text_800": ("text", 800), "title_80": ("title", 80)}
    return a.select("article_id", *[TX.truncate(F.col(c), n).alias(k) for k, (c, n) in sizes.items()])


@query
def select_features(spark, sf_dir):
    return rounded(CN.select_features(views.affect(spark, sf_dir)), 6, *V.FEATURES)


@query
def label_encode(spark, sf_dir):
    y = CN.encode_label(views.articles(spark, sf_dir)).withColumn("pred", F.col("y"))
    return CL.decode_label(y).select("article_id", "y", "label_pred")


@query
def filter_label(spark, sf_dir):
    return CN.filter_label(views.articles(spark, sf_dir), "fake").select("article_id", "source")


@query
def fill_features(spark, sf_dir):
    filled = CN.fill_features(views.affect(spark, sf_dir)).select("article_id", *V.FEATURES)
    return rounded(filled, 6, *V.FEATURES)


@query
def row_lookup(spark, sf_dir):
    return CN.row_lookup(views.documents(spark, sf_dir), 15).select("article_id", "source", "text")


@query
def table_summary(spark, sf_dir):
    return CN.table_summary(views.table(spark, sf_dir, "documents"))


@query
def table_head(spark, sf_dir):
    return views.articles(spark, sf_dir).orderBy("article_id").limit(5)


@query
def concat_articles(spark, sf_dir):
    documents = views.articles(spark, sf_dir).select("article_id", "source", "title", "label")
    pages = views.evidence_corpus(spark, sf_dir).select(
        F.col("page_id").alias("article_id"), F.lit("web").alias("source"), "title"
    )
    return CN.concat_articles(documents, pages)


@query
def row_numbers(spark, sf_dir):
    """Documents, then pages, numbered in the order of their files."""
    documents = views.documents(spark, sf_dir).select("article_id", "source", "title")
    pages = views.evidence_corpus(spark, sf_dir).select(F.col("page_id").alias("article_id"), "title")
    return CN.with_row_number(CN.concat_articles(documents, pages))


@query
def sample_n(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return CN.sample_n(lines, F.concat_ws("-", "l_orderkey", "l_linenumber"))


# --- text ----------------------------------------------------------------------------------


@query
def parse_float(spark, sf_dir):
    return views.replies(spark, sf_dir).select("article_id", TX.parse_float(F.col("raw")).alias("score"))


@query
def parse_voc(spark, sf_dir):
    return views.replies(spark, sf_dir).select("article_id", TX.parse_voc(F.col("raw")).alias("voc"))


@query
def parse_ec(spark, sf_dir):
    return views.replies(spark, sf_dir).select(
        "article_id", joined(TX.parse_ec(F.col("raw"))).alias("ec")
    )


@query
def parse_verdict(spark, sf_dir):
    return EV.parse_verdicts(views.verdict_raw(spark, sf_dir))


@query
def clean_query(spark, sf_dir):
    return views.query_raw(spark, sf_dir).select("article_id", TX.clean_query(F.col("raw")).alias("query"))


@query
def prompt_fanout(spark, sf_dir):
    return PR.prompt_fanout(views.cleaned_documents(spark, sf_dir))


@query
def query_prompt(spark, sf_dir):
    return views.cleaned_documents(spark, sf_dir).select(
        "article_id", PR.query_prompt(F.col("full_text")).alias("prompt")
    )


@query
def scorer_inputs(spark, sf_dir):
    inputs = PR.embedding_inputs(views.cleaned_documents(spark, sf_dir))
    return inputs.select("article_id", F.posexplode("candidates").alias("attempt", "prompt"))


# --- affect --------------------------------------------------------------------------------


@query
def affect_profile(spark, sf_dir):
    profile = SC.affect_profile(views.task_replies(spark, sf_dir))
    return profile.withColumn("ec", joined(F.col("ec")))


@query
def attach_profile(spark, sf_dir):
    articles = views.documents(spark, sf_dir).select("article_id", "source")
    profiles = views.affect(spark, sf_dir).select("article_id", *V.AFFECT_COLUMNS)
    return rounded(SC.attach_profile(articles, profiles), 6, *V.FEATURES)


@query
def dominant_emotion(spark, sf_dir):
    return views.affect(spark, sf_dir).select("article_id", AF.dominant_emotion().alias("dominant"))


@query
def vreg_bucket(spark, sf_dir):
    return views.affect(spark, sf_dir).select("article_id", AF.vreg_bucket(F.col("vreg")).alias("bucket"))


# --- statistics ----------------------------------------------------------------------------


@query
def label_counts(spark, sf_dir):
    return ST.label_counts(views.articles(spark, sf_dir))


@query
def source_label_counts(spark, sf_dir):
    return ST.source_label_counts(views.articles(spark, sf_dir))


@query
def mean_affect_by_label(spark, sf_dir):
    return ST.mean_affect(views.affect(spark, sf_dir), ["label"])


@query
def mean_affect_by_source_label(spark, sf_dir):
    return ST.mean_affect(views.affect(spark, sf_dir), ["source", "label"], digits=3)


MOMENTS = ["real_mean", "real_var", "fake_mean", "fake_var", "t"]


@query
def ttest_by_label(spark, sf_dir):
    return rounded(rounded(ST.ttest_by_label(views.affect(spark, sf_dir)), 6, *MOMENTS), 8, "p")


@query
def paper_table(spark, sf_dir):
    return rounded(rounded(ST.paper_table(views.affect(spark, sf_dir)), 6, *MOMENTS), 8, "p")


@query
def high_emotion_counts(spark, sf_dir):
    return ST.high_emotion_counts(views.affect(spark, sf_dir))


@query
def high_emotion_share(spark, sf_dir):
    return rounded(
        ST.high_emotion_share(views.affect(spark, sf_dir)), 6, "fake_pct", "real_pct", "lift"
    )


@query
def dominant_crosstab(spark, sf_dir):
    return ST.dominant_crosstab(views.affect(spark, sf_dir))


@query
def dominant_pct(spark, sf_dir):
    return ST.dominant_pct(views.affect(spark, sf_dir))


@query
def bucket_crosstab(spark, sf_dir):
    return ST.bucket_crosstab(views.affect(spark, sf_dir))


@query
def bucket_pct(spark, sf_dir):
    return ST.bucket_pct(views.affect(spark, sf_dir))


@query
def affect_histogram(spark, sf_dir):
    return rounded(ST.affect_histogram(views.affect(spark, sf_dir)), 6, "bin_start", "bin_end")


# --- vectors -------------------------------------------------------------------------------


@query
def vector_norm(spark, sf_dir):
    return views.vectors(spark, sf_dir).select(
        "article_id", F.round(VE.norm(F.col("embedding")), 6).alias("norm")
    )


@query
def cosine_similarity(spark, sf_dir):
    """Each vector against the one with the next id."""
    v = views.vectors(spark, sf_dir)
    following = v.select((F.col("article_id") - 1).alias("article_id"), F.col("embedding").alias("other"))
    cosine = F.round(VE.cosine(F.col("embedding"), F.col("other")), 6) + F.lit(0.0)
    return v.join(following, "article_id").select("article_id", cosine.alias("cosine"))


@query
def mean_pool(spark, sf_dir):
    """Each vector as eight token vectors of an eighth of its length, pooled."""
    part = (F.size("embedding") / 8).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * part + 1, part))
    pooled = views.vectors(spark, sf_dir).select(
        "article_id", F.posexplode(VE.mean_pool(tokens)).alias("position", "value")
    )
    return pooled.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query
def retrieve_top4(spark, sf_dir):
    return RE.retrieve_top_k(views.vectors(spark, sf_dir), 4)


@query
def retrieve_by_lists(spark, sf_dir):
    return RE.retrieve_by_lists(views.vectors(spark, sf_dir), 4)


# --- evidence and verdicts -----------------------------------------------------------------


def _matches(spark, sf_dir) -> DataFrame:
    articles = views.documents(spark, sf_dir).select("article_id", "text")
    return EV.evidence_top_k(articles, views.evidence_corpus(spark, sf_dir))


def _evidence(spark, sf_dir) -> DataFrame:
    return EV.evidence_text(_matches(spark, sf_dir), views.evidence_corpus(spark, sf_dir))


@query
def evidence_top_k(spark, sf_dir):
    return _matches(spark, sf_dir)


@query
def evidence_text(spark, sf_dir):
    return _evidence(spark, sf_dir).withColumn("sources", joined(F.col("sources")))


@query
def search_evidence(spark, sf_dir):
    """Each page as the only result of a search, its title as the answer."""
    record = F.struct("url", "title", "content")
    responses = views.evidence_corpus(spark, sf_dir).select(
        F.col("page_id").alias("article_id"), F.col("title").alias("answer"), F.array(record).alias("results")
    )
    return EV.search_evidence(responses).withColumn("sources", joined(F.col("sources")))


@query
def verdict_prompt(spark, sf_dir):
    articles = views.cleaned_documents(spark, sf_dir).select("article_id", "full_text")
    # The title of the page with the article's number stands in for the search's own answer.
    answers = views.evidence_corpus(spark, sf_dir).select(
        F.col("page_id").alias("article_id"), F.col("title").alias("answer")
    )
    with_evidence = EV.attach_evidence(articles, _evidence(spark, sf_dir)).join(
        answers, "article_id", "left"
    )
    answer = F.coalesce("answer", F.lit(""))
    prompt = PR.verdict_prompt(F.col("full_text"), answer, F.col("evidence_text"))
    return with_evidence.select("article_id", prompt.alias("prompt"))


@query
def verified_article(spark, sf_dir):
    queries = views.query_raw(spark, sf_dir).select(
        "article_id", TX.clean_query(F.col("raw")).alias("query")
    )
    verdicts = EV.parse_verdicts(views.verdict_raw(spark, sf_dir))
    result = EV.verified_article(
        views.documents(spark, sf_dir), queries, _evidence(spark, sf_dir), verdicts
    )
    return result.withColumn("sources", joined(F.col("sources")))


@query
def assemble_prompt_inputs(spark, sf_dir):
    result = EV.assemble_prompt_inputs(
        views.cleaned_articles(spark, sf_dir),
        RE.retrieve_top_k(views.vectors(spark, sf_dir), 4),
        views.affect(spark, sf_dir),
        EV.parse_verdicts(views.verdict_raw(spark, sf_dir)),
    )
    examples = F.transform(
        "neighbours",
        lambda n: F.concat_ws(
            ":", n["neighbour_id"].cast("string"), F.coalesce(n["label"], F.lit("none")),
            F.coalesce(F.round(n["vreg"] * 1000).cast("int").cast("string"), F.lit("none")),
            F.coalesce(F.left(n["text"], F.lit(40)), F.lit("")),
        ),
    )
    neighbours = joined(F.col("neighbours.neighbour_id").cast("array<string>"))
    named = result.withColumn("examples", F.array_join(examples, " | "))
    return rounded(named.withColumn("neighbours", neighbours), 6, "vreg")


# --- classification ------------------------------------------------------------------------


def _filled(spark, sf_dir) -> DataFrame:
    return CN.fill_features(views.affect(spark, sf_dir))


@query
def standardize(spark, sf_dir):
    scaled = CL.standardize(views.affect(spark, sf_dir)).select("article_id", *V.FEATURES)
    return rounded(scaled, 6, *V.FEATURES)


@query
def class_centroids(spark, sf_dir):
    return CL.class_centroids(_filled(spark, sf_dir))


@query
def nearest_centroid(spark, sf_dir):
    return CL.nearest_centroid(_filled(spark, sf_dir))


SCORES = ["f1_weighted", "accuracy", "precision_weighted", "recall_weighted"]


@query
def nearest_centroid_cv(spark, sf_dir):
    return rounded(CL.nearest_centroid_cv(_filled(spark, sf_dir)), 6, *SCORES)


@query
def cv_summary(spark, sf_dir):
    scores = CL.nearest_centroid_cv(_filled(spark, sf_dir), scale="global")
    return rounded(CL.cv_summary(scores, SCORES), 6, "mean", "std")


@query
def affective_distance(spark, sf_dir):
    return CL.affective_distance(_filled(spark, sf_dir))


@query
def stratified_folds(spark, sf_dir):
    return CL.stratified_folds(views.affect(spark, sf_dir)).select("article_id", "label", "fold")


@query
def stratified_folds_shuffled(spark, sf_dir):
    folds = CL.stratified_folds(views.affect(spark, sf_dir), seed=V.SEED)
    return folds.select("article_id", "label", "fold")


@query
def classification_report(spark, sf_dir):
    report = CL.classification_report(CL.nearest_centroid(_filled(spark, sf_dir)))
    return rounded(report, 6, "precision", "recall", "f1")


@query
def method_summary(spark, sf_dir):
    return rounded(CL.method_summary(MO.all_methods(_filled(spark, sf_dir))), 6, "f1_weighted", "accuracy")


@query
def kmeans_labels(spark, sf_dir):
    return MO.kmeans_labels(_filled(spark, sf_dir))


@query
def gmm_labels(spark, sf_dir):
    return rounded(MO.gmm_labels(_filled(spark, sf_dir)), 6, "prob_0", "prob_1")


@query
def logreg_cv(spark, sf_dir):
    return rounded(MO.logreg_cv(views.affect(spark, sf_dir)), 6, "mean", "std")


@query
def logreg_weights(spark, sf_dir):
    affect = views.affect(spark, sf_dir)
    return rounded(MO.logreg_weights(MO.train_classifier(affect), affect), 6, "weight")


@query
def classify_affect(spark, sf_dir):
    affect = views.affect(spark, sf_dir)
    return MO.classify_affect(MO.train_classifier(affect), affect).select(
        "article_id", "label", "affect_pred", "affect_confidence"
    )
