"""The retrying stream: prompts that fail are asked again, across restarts, up to a bound."""

import os
import sys
import time

from pyspark import cloudpickle

from newsgauge.operators import scoring as SC
from newsgauge.session import new_path
from newsgauge.streaming import retry

SCHEMA = "article_id long, title string, text string"


def failing_scorer(folder):
    """Leaves a file for each try of a prompt; "shaky" ones fail twice, "hopeless" ones always."""

    def score(prompts):
        import hashlib
        import os
        import uuid

        out = []
        for p in prompts:
            name = hashlib.md5(p.encode()).hexdigest()
            tries = sum(f.startswith(name) for f in os.listdir(folder))
            open(f"{folder}/{name}-{uuid.uuid4().hex}", "w").close()
            if "hopeless" in p or ("shaky" in p and tries < 2):
                raise RuntimeError("not now")
            out.append("0.5")
        return out

    return score


def wait_for(check, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return
        time.sleep(0.5)
    raise AssertionError("nothing more came")


def test_failed_prompts_are_asked_again_across_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    source, output, checkpoint = (new_path(spark, n) for n in ("in", "out", "progress"))
    rows = [(0, "fine", "text " * 10), (1, "shaky", "text " * 10), (2, "hopeless", "text " * 10)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)

    scorer = failing_scorer(folder)
    # The state worker cannot import this file, so the functions go by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def start(wait_ms):
        return retry.stream_scores_with_retry(
            spark, source, output, checkpoint, lambda: scorer, tries=4, wait_ms=wait_ms, every="1 second"
        )

    def replies():
        if not os.path.isdir(f"{output}/_spark_metadata"):
            return []
        return spark.read.schema(SC.REPLY_SCHEMA).parquet(output).collect()

    query = start(4000)
    try:
        wait_for(lambda: len(replies()) >= 7)
    finally:
        query.stop()
    assert {r.article_id for r in replies()} <= {0, 1}
    query = start(500)
    try:
        wait_for(lambda: len(replies()) >= 21)
        time.sleep(3)
    finally:
        query.stop()
    got = replies()
    assert len(got) == 21 and len({(r.article_id, r.task, r.emotion) for r in got}) == 21
    assert all((r.status == SC.OK) == (r.article_id < 2) for r in got)
    assert all("not now" in r.status for r in got if r.article_id == 2)
    assert all(r.raw == "0.5" for r in got if r.article_id < 2)


def first_refusing_scorer(folder):
    """Refuses each prompt once; leaves a file for each call, with the number of its prompts."""

    def score(prompts):
        import hashlib
        import os
        import uuid

        with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as call:
            call.write(str(len(prompts)))
        for p in prompts:
            name = f"{folder}/{hashlib.md5(p.encode()).hexdigest()}"
            if not os.path.exists(name):
                open(name, "w").close()
                raise RuntimeError("not now")
        return [f"0.{len(p) % 97}" for p in prompts]

    return score


def test_articles_share_the_state_and_the_batches_of_a_bucket(spark, tmp_path):
    folder = str(tmp_path)
    source, output, checkpoint = (new_path(spark, n) for n in ("in", "out", "progress"))
    # More prompts wait in a bucket than one value of the state takes; ids that a float cannot hold, and none.
    ids = [2**53 + 2 * i + 1 for i in range(199)] + [None]
    rows = [(i, f"title {n}", f"text number {n}") for n, i in enumerate(ids)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    scorer = first_refusing_scorer(folder)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def replies():
        if not os.path.isdir(f"{output}/_spark_metadata"):
            return []
        return spark.read.schema(SC.REPLY_SCHEMA).parquet(output).collect()

    query = retry.stream_scores_with_retry(
        spark, source, output, checkpoint, lambda: scorer, wait_ms=0, every="1 second", batch_rows=50, buckets=2
    )
    try:
        wait_for(lambda: len(replies()) >= 1400)
        time.sleep(3)
    finally:
        query.stop()
    got = replies()
    assert len(got) == 1400 and all(r.status == SC.OK for r in got)
    assert {(r.article_id, r.task, r.emotion) for r in got} == {
        (i, t, e) for i in ids for t, e in {(r.task, r.emotion) for r in got}
    }
    calls = [int(p.read_text()) for p in tmp_path.glob("call-*")]
    # One by one where a batch failed; those that waited come again in whole batches.
    assert max(calls) == 50 and sum(n == 50 for n in calls) >= 48
