"""Resumable scoring: only articles without a result are scored, by batch or by stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as V
from newsgauge.functions import text as TX
from newsgauge.functions.prompts import prompt_fanout
from newsgauge.operators.scoring import OK, REPLY_SCHEMA, Scorer, score_batch


def resume_todo(articles: DataFrame, done: DataFrame) -> DataFrame:
    """Articles that have no finished result yet; failed ones come again.

    ``done`` has ``article_id`` and, where results may fail, ``status`` (and ``task, emotion``).
    An article is finished once each of its tasks has succeeded.
    """
    if "status" in done.columns:
        tasks = ["article_id", *[c for c in ("task", "emotion") if c in done.columns]]
        succeeded = (F.col("status") == OK).cast("int")
        # Partitioned once, for both aggregates and the join.
        done = (
            done.repartition("article_id").groupBy(*tasks).agg(F.max(succeeded).alias("good"))
            .groupBy("article_id").agg(F.min("good").alias("good"))
            .where(F.col("good") == 1)
        )
    return articles.join(done.select("article_id"), "article_id", "left_anti")


def latest_replies(replies: DataFrame) -> DataFrame:
    """One row per article, task and emotion after retries: a good reply before a failed one."""
    best = F.min_by(F.struct("raw", "status"), (F.col("status") != OK).cast("int"))
    return (
        replies.groupBy("article_id", "task", "emotion")
        .agg(best.alias("r"))
        .select("article_id", "task", "emotion", "r.*")
    )


def open_prompts(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Prompts ``article_id, task, emotion, ..`` without a good reply yet."""
    good = replies.where(F.col("status") == OK).select(
        F.col("article_id").alias("a"), F.col("task").alias("t"), F.col("emotion").alias("e")
    )
    same = (
        (F.col("article_id") == F.col("a"))
        & (F.col("task") == F.col("t"))
        & F.col("emotion").eqNullSafe(F.col("e"))
    )
    return prompts.join(good, same, "left_anti")


def score_new(
    spark: SparkSession,
    articles: DataFrame,
    output: str,
    make_scorer: Callable[[], Scorer],
    max_chars: int = V.MAX_PROMPT_CHARS,
    steps: int = 1,
) -> None:
    """Score the prompts without a good reply in ``output`` (Parquet) and append the replies.

    Each of ``steps`` parts of the articles, by a hash of their id, is committed when it is done,
    so a lost run repeats one part at most; what has been answered is never asked again.
    """
    for step in range(steps):
        try:
            finished = spark.read.schema(REPLY_SCHEMA).parquet(output)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            finished = spark.createDataFrame([], REPLY_SCHEMA)
        part = articles.where(F.pmod(F.xxhash64("article_id"), F.lit(steps)) == step)
        todo = open_prompts(prompt_fanout(part, max_chars=max_chars), finished)
        score_batch(todo, make_scorer).write.mode("append").parquet(output)


def stream_scores(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoint: str,
    make_scorer: Callable[[], Scorer],
    schema: str = "article_id bigint, title string, text string",
    files_per_batch: int = 1000,
    max_chars: int = V.MAX_PROMPT_CHARS,
) -> None:
    """Score the article files (Parquet) that came since the last run, then stop.

    The checkpoint remembers the files done and the sink commits whole micro-batches, so a
    restart after a lost job neither skips nor repeats a file. Prompts that failed are found by
    ``open_prompts`` on the output, and are scored by ``score_new`` into a table of their own.
    """
    articles = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    prepared = articles.withColumn("full_text", TX.full_text(F.col("title"), F.col("text")))
    replies = score_batch(prompt_fanout(prepared, max_chars=max_chars), make_scorer)
    query = (
        replies.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
