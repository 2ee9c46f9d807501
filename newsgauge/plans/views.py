"""Input views over the given tables, see FIXTURES.md. ``sf_dir`` holds one parquet per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.functions import text as TX


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article_id, source, lang, title, text``: a narrow plan, for all that needs no label."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        "source",
        "lang",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        "text",
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` and their label, null where unlabelled; fake if any label row says toxic."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("article_id"))
    toxic = labels.agg(F.max("toxic").alias("toxic"))
    return documents(spark, sf_dir).join(toxic, "article_id", "left").withColumn(
        "label", F.when(F.col("toxic") == 1, "fake").when(F.col("toxic") == 0, "real")
    ).drop("toxic")


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn(
        "full_text", TX.full_text(F.col("title"), F.col("text"))
    )


def cleaned_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).withColumn(
        "full_text", TX.full_text(F.col("title"), F.col("text"))
    )


def _score(position: int) -> Column:
    value = F.element_at("embedding", position).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.lit(2.0) * value))


def affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affect table; embedding coordinates stand in for model scores, as there is no model."""
    vec_id = F.col("vec_id")
    voc = F.floor(F.element_at("embedding", 6).cast("double") * 16)
    return table(spark, sf_dir, "embeddings").select(
        vec_id.alias("article_id"),
        F.when(vec_id % 3 == 0, "domA").otherwise("domB").alias("source"),
        F.when(F.col("label") % 2 == 0, "fake").otherwise("real").alias("label"),
        F.when(vec_id % 17 != 0, _score(1)).alias("vreg"),
        _score(2).alias("eireg_anger"),
        _score(3).alias("eireg_fear"),
        _score(4).alias("eireg_joy"),
        _score(5).alias("eireg_sadness"),
        F.greatest(F.lit(-3), F.least(F.lit(3), voc)).cast("int").alias("voc"),
    )


def _reply(n: Column) -> Column:
    s = lambda c: c.cast("string")
    return (
        F.when(n % 6 == 0, F.concat(F.lit("Score: 0."), s(n % 97)))
        .when(n % 6 == 1, F.concat(F.lit("-"), s(n % 5), F.lit(" overall")))
        .when(n % 6 == 2, "no score")
        .when(n % 6 == 3, F.concat(F.lit("."), s(n % 9), F.lit(" out of 1")))
        .when(n % 6 == 4, "99999999999999999999999 Anger, JOYFUL and distrust")
        .otherwise("")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model reply per article, ``article_id, raw``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), _reply(F.col("n_chars")).alias("raw")
    )


def task_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven model replies per article: ``article_id, task, emotion, raw``."""
    tasks = ["vreg", "voc", "anger", "fear", "joy", "sadness", "ec"]
    rows = []
    for i, task in enumerate(tasks):
        emotion = F.lit(task if 2 <= i <= 5 else None).cast("string")
        name = F.lit("eireg" if 2 <= i <= 5 else task)
        rows.append(
            F.struct(
                name.alias("task"), emotion.alias("emotion"), _reply(F.col("n_chars") + i).alias("raw")
            )
        )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), F.inline(F.array(*rows))
    )


def verdict_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact-check reply per article: prose around JSON, missing fields, no or broken JSON."""
    p = F.col("page_id")
    raw = (
        F.when(
            p % 5 == 0,
            F.concat(
                F.lit('Sure: {"verdict": "SUPPORTED", "confidence": 0.'),
                (p % 89).cast("string"),
                F.lit(', "explanation": "e'),
                p.cast("string"),
                F.lit('"} done'),
            ),
        )
        .when(p % 5 == 1, '{"verdict": "CONTRADICTED", "confidence": "0.9"}')
        .when(p % 5 == 2, "I cannot tell.")
        .when(p % 5 == 3, '{"verdict": "SUPPORTED", "confidence": "high", "explanation": "z"}')
        .otherwise("} broken {")
    )
    return table(spark, sf_dir, "pages").select(p.alias("article_id"), raw.alias("raw"))


def query_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-query replies: page titles in the quotes and spaces a model may add."""
    title = TX.page_title(F.col("html"))
    quoted = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(' "'), title, F.lit('"\n')))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("\"'"), title, F.lit("'\"")))
        .otherwise(title)
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("article_id"), quoted.alias("raw")
    )


def evidence_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, title, content`` from the raw pages."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        TX.page_title(F.col("html")).alias("title"),
        TX.page_content(F.col("html")).alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article_id, domain, embedding``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("label").alias("domain"), "embedding"
    )
