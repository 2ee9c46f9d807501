"""The plans, where their shape matters at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from newsgauge.functions.prompts import prompt_fanout
from newsgauge.operators import classify as CL
from newsgauge.operators import clean as CN
from newsgauge.operators import models as MO
from newsgauge.operators import scoring as SC
from newsgauge.operators import stats as ST
from newsgauge.plans import views
from newsgauge.session import new_path
from newsgauge.sources import sinks, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def affect(spark, sf_dir):
    path = new_path(spark, "plan-affect")
    sinks.sink_parquet(views.affect(spark, sf_dir), path)
    return tables.scan_parquet(spark, path)


def exchanges(df):
    return plan(df).count("Exchange ")


@pytest.mark.parametrize(
    "operator",
    [
        lambda a: ST.mean_affect(a, ["source", "label"]),
        ST.high_emotion_counts,
        ST.high_emotion_share,
        ST.dominant_pct,
        ST.bucket_pct,
        CL.class_centroids,
        lambda a: CL.classification_report(CL.nearest_centroid(a)),
        CN.table_summary,
        SC.affect_profile,
    ],
)
def test_one_shuffle_of_partial_results(spark, sf_dir, affect, operator):
    df = operator(views.task_replies(spark, sf_dir) if operator is SC.affect_profile else affect)
    assert exchanges(df) == 1
    assert plan(df).count("HashAggregate") == 2 and "SortAggregate" not in plan(df)


@pytest.mark.parametrize(
    "operator",
    [
        CL.standardize,
        CL.nearest_centroid,
        CL.affective_distance,
        CL.stratified_folds,
        lambda a: CL.stratified_folds(a, seed=42),
        lambda a: CN.sample_n(a, F.col("article_id"), 100),
        lambda a: MO.classify_affect(MO.train_classifier(a), a),
        CN.fill_features,
    ],
)
def test_applied_without_a_shuffle(affect, operator):
    df = operator(affect)
    assert exchanges(df) == 0 and "Join" not in plan(df)


def test_fanout_is_narrow(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "article_id")
    df = prompt_fanout(documents, "text")
    assert exchanges(df) == 0
    assert "ReadSchema: struct<article_id" not in plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(df)


def test_filters_and_columns_reach_the_scan(affect):
    df = ST.mean_affect(CN.filter_label(affect, "fake"), ["source"], ["eireg_joy"])
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,fake), IsNotNull(source)]" in plan(df)
    assert "ReadSchema: struct<source:string,label:string,eireg_joy:double>" in plan(df)


def test_statistics_stay_in_the_jvm(affect):
    for operator in (ST.dominant_pct, ST.affect_histogram, ST.high_emotion_counts):
        assert "Python" not in plan(operator(affect)) and "Pandas" not in plan(operator(affect))


PAIRLESS = [n for n in E.queries() if n not in ("method_summary", "kmeans_labels", "gmm_labels", "logreg_cv")]


@pytest.mark.parametrize("name", PAIRLESS)
def test_no_cartesian_join(spark, sf_dir, name):
    text = plan(E.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name",
    ["full_text", "filter_short", "truncate_text", "prompt_fanout", "query_prompt", "scorer_inputs",
     "score_batch", "embed_batch"],
)
def test_no_shuffle_where_no_label_is_used(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(E.queries()[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_second_label_rows_do_not_double_articles(spark, tmp_path):
    docs = [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1), (3, "c", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    rows = views.articles(spark, str(tmp_path)).collect()
    assert sorted((r.article_id, r.label) for r in rows) == [(1, "fake"), (2, "real"), (3, None)]
