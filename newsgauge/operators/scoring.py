"""Batch scoring with a user's model, and affect profiles from its replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.functions import fixed_values as V
from newsgauge.functions import text as TX

Scorer = Callable[[Sequence[str]], Sequence[str]]
REPLY_SCHEMA = "article_id bigint, task string, emotion string, raw string, status string"
VECTOR_SCHEMA = "article_id bigint, embedding array<float>, status string"
OK = "ok"


def _one(scorer: Scorer, prompt: str) -> tuple[str | None, str]:
    try:
        return scorer([prompt])[0], OK
    except Exception as error:  # noqa: BLE001 - the user's model may raise anything
        return None, f"error: {error}"


def _many(scorer: Scorer, batch: Sequence[str]) -> list[tuple[str | None, str]]:
    try:
        replies = list(scorer(batch))
        if len(replies) == len(batch):
            return [(reply, OK) for reply in replies]
    except Exception:  # noqa: BLE001 - find the failing prompts one by one
        pass
    return [_one(scorer, prompt) for prompt in batch]


def score_batch(
    prompts: DataFrame, make_scorer: Callable[[], Scorer], batch_rows: int = 64,
    partitions: int | None = None,
) -> DataFrame:
    """Run a user's model over ``article_id, task, emotion, prompt``.

    ``make_scorer`` is called once per task and returns a function from prompts to replies.
    A prompt that fails gets a null reply and the error as status; the others go on.
    ``partitions`` spreads the prompts where the table has too few parts for the model's cost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            texts = batch["prompt"].tolist()
            pairs = []
            for start in range(0, len(texts), batch_rows):
                pairs += _many(scorer, texts[start : start + batch_rows])
            yield pd.DataFrame(
                {
                    "article_id": batch["article_id"],
                    "task": batch["task"],
                    "emotion": batch["emotion"],
                    "raw": pd.Series([p[0] for p in pairs], index=batch.index, dtype=object),
                    "status": [p[1] for p in pairs],
                }
            )

    spread = prompts.repartition(partitions, "article_id", "task") if partitions else prompts
    return spread.select("article_id", "task", "emotion", "prompt").mapInPandas(run, REPLY_SCHEMA)


def score_with_kept_model(
    prompts: DataFrame, make_scorer: Callable[[], Scorer], batch_rows: int = 64
) -> DataFrame:
    """``score_batch`` with one model per worker process, kept for all its tasks.

    For models that are slow to load: ``predict_batch_udf`` loads the model when a worker first
    needs it, and hands it ``batch_rows`` prompts at a time. Prompts that fail are found one by one.
    """

    def make_predict() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        scorer = make_scorer()

        def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
            replies, statuses = zip(*_many(scorer, batch.tolist()))
            # Objects, as a reply may be null.
            return {"raw": np.array(replies, dtype=object), "status": np.array(statuses, dtype=object)}

        return predict

    reply = T.StructType([T.StructField("raw", T.StringType()), T.StructField("status", T.StringType())])
    predict = predict_batch_udf(make_predict, return_type=reply, batch_size=batch_rows)
    scored = prompts.select("article_id", "task", "emotion", predict(F.col("prompt")).alias("r"))
    return scored.select("article_id", "task", "emotion", "r.raw", "r.status")


def embed_batch(
    inputs: DataFrame, make_embedder: Callable[[], Callable[[str], Sequence[float]]]
) -> DataFrame:
    """Run a user's embedding model over ``article_id, candidates``.

    The candidates are tried in order; where all fail the embedding is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make_embedder()
        for batch in batches:
            vectors, statuses = [], []
            for candidates in batch["candidates"]:
                vector, status = None, "error: no candidate"
                for text in candidates:
                    try:
                        vector, status = [float(x) for x in embed(text)], OK
                        break
                    except Exception as error:  # noqa: BLE001
                        status = f"error: {error}"
                vectors.append(vector)
                statuses.append(status)
            yield pd.DataFrame(
                {"article_id": batch["article_id"], "embedding": vectors, "status": statuses}
            )

    return inputs.select("article_id", "candidates").mapInPandas(run, VECTOR_SCHEMA)


def affect_profile(replies: DataFrame) -> DataFrame:
    """Seven replies per article (``article_id, task, emotion, raw``) to one profile row.

    A missing or failed reply leaves its score null.
    """
    raw = F.col("raw")

    def one(condition, value):
        return F.max(F.when(condition, value))

    task, emotion = F.col("task"), F.col("emotion")
    # The emotions travel as bits: all buffers are numbers, so Spark can aggregate by hash.
    profile = replies.groupBy("article_id").agg(
        one(task == "vreg", TX.parse_float(raw)).alias("vreg"),
        one(task == "voc", TX.parse_voc(raw)).alias("voc"),
        *[
            one((task == "eireg") & (emotion == e), TX.parse_float(raw)).alias(f"eireg_{e}")
            for e in V.INTENSITY_EMOTIONS
        ],
        one(task == "ec", TX.emotion_bits(raw)).alias("ec"),
    )
    return profile.withColumn("ec", TX.emotion_names(F.col("ec")))


def attach_profile(articles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join on the article: articles not scored yet have null scores."""
    return articles.join(profiles, "article_id", "left")
