"""Scoring by a stream that asks failed prompts again: keyed state with timers.

Articles are dealt to buckets by a hash of their id. A bucket is one key of the state, so the cost of
a key (messages to the state, small tables) is shared by its articles, and the model gets whole batches.
The state of a bucket holds the prompts that have no good reply yet, by the time they are due. They
wait, are asked again when the timer of that time ends, and are given up after a bounded number of
tries, so the state holds only prompts that still wait. Replies and state belong to one micro-batch: a
restart neither loses a waiting prompt nor repeats one that has been answered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsgauge.functions import fixed_values as V
from newsgauge.functions import text as TX
from newsgauge.functions.prompts import prompt_fanout
from newsgauge.operators.scoring import OK, Scorer, _many

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The article's id travels as text: as a number, pandas would round it where others are null.
WAITING = "prompts array<struct<article_id string, task string, emotion string, prompt string, tries int>>"
REPLIES = "article_id string, task string, emotion string, raw string, status string"
#: Prompts in one value of the state.
STATE_ROWS = 512


class RetryingScorer(StatefulProcessor):
    """Asks the prompts of a bucket of articles, and the failed ones again after ``wait_ms``.

    A prompt's last reply after ``tries`` tries is emitted with its error as status.
    """

    def __init__(self, make_scorer: Callable[[], Scorer], tries: int, wait_ms: int, batch_rows: int = 64):
        self.make_scorer, self.tries, self.batch_rows = make_scorer, tries, batch_rows
        # A timer set for the very time of the one that ends would be deleted with it.
        self.wait_ms = max(wait_ms, 1)
        self.scorer: Scorer | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "due bigint", "parts int")
        self.waiting = handle.getMapState("waiting", "due bigint, part int", WAITING)

    def _keep(self, prompts: list[tuple], due: int) -> None:
        """Adds prompts to those due at a time, in new parts: none that waits is read or written again."""
        known = self.parts.getValue((due,))
        part = known[0] if known else 0
        for start in range(0, len(prompts), STATE_ROWS):
            self.waiting.updateValue((due, part), (prompts[start : start + STATE_ROWS],))
            part += 1
        self.parts.updateValue((due,), (part,))
        self.handle.registerTimer(due)

    def _ask(self, prompts: list[tuple], now: int) -> pd.DataFrame:
        """Replies to emit; what failed goes to the state, with a timer."""
        if self.scorer is None:
            self.scorer = self.make_scorer()
        out, again = [], []
        for start in range(0, len(prompts), self.batch_rows):
            batch = prompts[start : start + self.batch_rows]
            replies = _many(self.scorer, [prompt for *_, prompt, _ in batch])
            for (article, task, emotion, prompt, before), (raw, status) in zip(batch, replies):
                if status == OK or before + 1 >= self.tries:
                    out.append((article, task, emotion, raw, status))
                else:
                    again.append((article, task, emotion, prompt, before + 1))
        if again:
            self._keep(again, now + self.wait_ms)
        columns = ["article_id", "task", "emotion", "raw", "status"]
        return pd.DataFrame(out, columns=columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[["article_id", "task", "emotion", "prompt"]]
            batch = batch.astype(object).where(batch.notna(), None)
            prompts = [(*r, 0) for r in batch.itertuples(index=False, name=None)]
            yield self._ask(prompts, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        (parts,) = self.parts.getValue((due,))
        self.parts.removeKey((due,))
        for part in range(parts):
            (prompts,) = self.waiting.getValue((due, part))
            self.waiting.removeKey((due, part))
            yield self._ask([tuple(p) for p in prompts], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stream_scores_with_retry(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoint: str,
    make_scorer: Callable[[], Scorer],
    tries: int = 3,
    wait_ms: int = 60_000,
    schema: str = "article_id bigint, title string, text string",
    files_per_batch: int = 1000,
    max_chars: int = V.MAX_PROMPT_CHARS,
    every: str = "10 seconds",
    batch_rows: int = 64,
    buckets: int = 4096,
) -> StreamingQuery:
    """Start to score the article files (Parquet) of a folder, and those still to come.

    The query runs until it is stopped; started again with the same checkpoint, it goes on with
    the prompts that wait. Needs the state store of RocksDB, which is set for this query only.
    The model gets up to ``batch_rows`` prompts at a time; ``buckets`` should be several times the
    number of shuffle partitions.
    """
    articles = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    prepared = articles.withColumn("full_text", TX.full_text(F.col("title"), F.col("text")))
    prompts = prompt_fanout(prepared, max_chars=max_chars)
    replies = (
        prompts.select(
            F.pmod(F.xxhash64("article_id"), F.lit(buckets)).alias("bucket"),
            F.col("article_id").cast("string").alias("article_id"), "task", "emotion", "prompt",
        )
        .groupBy("bucket")
        .transformWithStateInPandas(
            RetryingScorer(make_scorer, tries, wait_ms, batch_rows), REPLIES, "Append", "ProcessingTime"
        )
        .withColumn("article_id", F.col("article_id").cast("bigint"))
    )
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        return (
            replies.writeStream.format("parquet")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .trigger(processingTime=every)
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, before)
