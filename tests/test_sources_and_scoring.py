import glob
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from newsgauge.functions import fixed_values as V
from newsgauge.functions import prompts as PR
from newsgauge.operators import scoring as SC
from newsgauge.session import new_path
from newsgauge.sources import sinks, tables
from newsgauge.streaming import incremental as IN

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the scorers below

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("score", T.DoubleType()), T.StructField("voc", T.IntegerType()),
     T.StructField("ec", T.ArrayType(T.StringType()))]
)


def write(path, content):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(content)
    return str(path)


def test_csv_cells(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'id,text,score,voc,ec\n'
        '1,"two\nlines, ""quoted""",0.5,1,"[\'anger\', \'fear\']"\n'
        '2,NA,nan,2.0,[]\n'
        '3,na,,,\n'
        '4,  spaced ,1e-3,-3,N/A\n'
        '5,"",NULL,NaN,None\n',
    )
    rows = [tuple(r) for r in tables.scan_csv(spark, path, SCHEMA).orderBy("id").collect()]
    assert rows == [
        (1, 'two\nlines, "quoted"', 0.5, 1, ["anger", "fear"]),
        (2, None, None, 2, []),
        (3, "na", None, None, None),
        (4, "  spaced ", 0.001, -3, None),
        (5, None, None, None, None),
    ]


def test_columns_are_found_by_name(spark, tmp_path):
    """Reordered, further and missing columns, as in files of different origin."""
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", 'title,id,text\nMyTitle,7,"a\nb"\n')
    write(folder / "b c.csv", "text,other,id\nt,x,8\n")
    write(folder / "d.csv", "id,title,text\n9,T,u\n")
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
         T.StructField("text", T.StringType())]
    )
    rows = tables.scan_csv(spark, str(folder), schema).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(7, "MyTitle", "a\nb"), (8, None, "t"), (9, "T", "u")]


def test_article_file_with_further_columns(spark, tmp_path):
    names = [f.name for f in tables.ARTICLE_SCHEMA]
    wide = ["url", *reversed(names), "source", "canonical", "meta"]
    cells = [f"v-{n}" for n in wide]
    write(tmp_path / "Site_fake.csv", ",".join(wide) + "\n" + ",".join(cells) + "\n")
    (row,) = tables.scan_labelled_files(spark, str(tmp_path)).collect()
    assert [row[n] for n in names] == [f"v-{n}" for n in names]
    assert (row.source, row.label) == ("Site", "fake") and len(row) == len(names) + 2


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.scan_csv(spark, str(tmp_path), SCHEMA)


def test_malformed_number_is_an_error(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,text,score,voc,ec\n1,x,high,1,[]\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.scan_csv(spark, path, SCHEMA).collect()


def test_string_scan_with_and_without_header(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,text\n1,NA\n2,\"b\nc\"\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    rows = [tuple(r) for r in tables.scan_csv_strings(spark, path, schema, header=False).collect()]
    assert rows == [("id", "text"), ("1", "NA"), ("2", "b\nc")]
    rows = [r.asDict() for r in tables.scan_csv_strings(spark, path, schema).collect()]
    assert rows == [{"id": "1", "text": "NA"}, {"id": "2", "text": "b\nc"}]


def test_labelled_files(spark, tmp_path):
    for name in ("BuzzFeed_fake", "BuzzFeed_real", "PolitiFact_fake"):
        write(tmp_path / f"{name}_news_content.csv", f"id,title,text,source\n1,{name},body,web\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "text", "source")])
    rows = tables.scan_labelled_files(spark, str(tmp_path), schema).collect()
    assert sorted((r.title, r.source, r.label) for r in rows) == [
        ("BuzzFeed_fake", "BuzzFeed", "fake"), ("BuzzFeed_real", "BuzzFeed", "real"),
        ("PolitiFact_fake", "PolitiFact", "fake"),
    ]


def test_csv_roundtrip_of_hard_text(spark):
    texts = ['a "b", c', "line\nbreak", " lead and trail ", "back\\slash", "ü😀", "'q'", "a,b;c"]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("ec", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(i, t, ["joy", t]) for i, t in enumerate(texts)] + [(99, None, None)], schema)
    path = new_path(spark, "roundtrip")
    sinks.sink_csv(df, path)
    back = tables.scan_csv(spark, path, schema).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(i, t, ["joy", t]) for i, t in enumerate(texts)] + [(99, None, None)]


def test_parquet_scan_prunes_and_cleans(spark):
    path = new_path(spark, "nan")
    sinks.sink_parquet(spark.createDataFrame([(1, float("nan"), "x")], "id long, v double, w string"), path)
    df = tables.scan_parquet(spark, path, ["id", "v"])
    assert [tuple(r) for r in df.collect()] == [(1, None)]
    assert "ReadSchema: struct<id:bigint,v:double>" in df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_sink_is_pruned(spark):
    rows = [(i, "big" if i % 3 else f"s{i}", "fake" if i % 2 else "real") for i in range(60)]
    path = new_path(spark, "parts")
    sinks.sink_partitioned(spark.createDataFrame(rows, "article_id long, source string, label string"), path)
    df = spark.read.parquet(path).where("source = 'big' and label = 'fake'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "(source" in plan
    assert df.count() == sum(r[1] == "big" and r[2] == "fake" for r in rows)
    assert os.path.isdir(f"{path}/source=big/label=fake")


def test_vector_sink_replaces_or_appends(spark):
    path = new_path(spark, "vec")
    vector = lambda i: spark.createDataFrame([(i, [1.0, 2.0])], "article_id long, embedding array<double>")
    for _ in range(2):  # a repeated run leaves no second copy
        sinks.sink_vectors(vector(0), path)
    sinks.sink_vectors(vector(1), path, mode="append")
    df = spark.read.parquet(path)
    assert df.count() == 2 and dict(df.dtypes)["embedding"] == "array<float>"


class Echo:
    def __call__(self, prompts):
        return [f"0.{len(p) % 10}" for p in prompts]


class Failing:
    """Fails on prompts that name a bad article."""

    def __call__(self, prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("context too long")
        return ["0.5"] * len(prompts)


ARTICLES = [(1, "good one"), (2, "bad one"), (3, "another good")]


def article_frame(spark, rows=ARTICLES):
    return spark.createDataFrame(rows, "article_id long, full_text string")


def test_a_failing_prompt_does_not_stop_the_others(spark):
    out = SC.score_batch(PR.prompt_fanout(article_frame(spark)).coalesce(1), Failing, batch_rows=5).collect()
    assert len(out) == 21
    for r in out:
        assert (r.raw, r.status) == ((None, "error: context too long") if r.article_id == 2 else ("0.5", "ok"))


def test_failed_articles_come_again(spark):
    output = new_path(spark, "retry")
    IN.score_new(spark, article_frame(spark), output, Failing)
    first = spark.read.parquet(output)
    assert [r.article_id for r in IN.resume_todo(article_frame(spark), first).collect()] == [2]
    IN.score_new(spark, article_frame(spark), output, Echo)
    everything = spark.read.parquet(output)
    assert IN.resume_todo(article_frame(spark), everything).count() == 0
    latest = IN.latest_replies(everything)
    assert latest.count() == 21 and latest.where("status <> 'ok'").count() == 0
    rows = everything.count()
    IN.score_new(spark, article_frame(spark), output, Echo)
    assert spark.read.parquet(output).count() == rows


class OneBadTask:
    """Fails on one of the seven prompts of an article."""

    def __call__(self, prompts):
        if any(p.startswith(V.VOC_PROMPT.split("{")[0]) for p in prompts):
            raise RuntimeError("no answer")
        return ["0.5"] * len(prompts)


@pytest.mark.parametrize("steps", [1, 3])
def test_only_prompts_without_a_good_reply_are_asked_again(spark, steps):
    output = new_path(spark, "per-prompt")
    IN.score_new(spark, article_frame(spark), output, OneBadTask, steps=steps)
    first = spark.read.parquet(output)
    assert (first.count(), first.where("status <> 'ok'").count()) == (21, 3)
    IN.score_new(spark, article_frame(spark), output, Echo, max_chars=3, steps=steps)
    everything = spark.read.parquet(output)
    assert everything.count() == 24
    assert IN.latest_replies(everything).where("status = 'ok'").count() == 21


def test_lengths_are_parameters(spark):
    (row,) = PR.embedding_inputs(article_frame(spark, [(1, "abcdef")]), lengths=(4, 2)).collect()
    assert [p.count("abcd") for p in row.candidates] == [1, 0] and "ab" in row.candidates[1]


def test_profile_from_replies(spark):
    rows = [(1, "vreg", None, "0.4"), (1, "voc", None, "-2"), (1, "eireg", "anger", "x"), (1, "eireg", "joy", "7"),
            (1, "ec", None, "Joy!"), (2, "vreg", None, None)]
    out = SC.affect_profile(spark.createDataFrame(rows, "article_id long, task string, emotion string, raw string"))
    first, second = out.orderBy("article_id").collect()
    assert tuple(first) == (1, 0.4, -2, 0.5, None, 1.0, None, ["joy"])
    assert tuple(second) == (2, None, None, None, None, None, None, None)
    joined = SC.attach_profile(article_frame(spark), out).orderBy("article_id").collect()
    assert [r.vreg for r in joined] == [0.4, None, None]


class Embedder:
    def __call__(self, text):
        if "bad" in text or len(text) > len(V.VREG_PROMPT) - 6 + 150:
            raise RuntimeError("llama_decode returned -3")
        return np.array([len(text), 1.0], dtype="float32")


def test_embedding_retries_shorter_texts(spark):
    rows = [(1, "x" * 400), (2, "bad"), (3, "y" * 10)]
    out = SC.embed_batch(PR.embedding_inputs(article_frame(spark, rows)), Embedder).orderBy("article_id").collect()
    base = len(V.VREG_PROMPT) - 6
    assert [r.embedding for r in out] == [[base + 150, 1.0], None, [base + 10, 1.0]]
    assert [r.status for r in out] == ["ok", "error: llama_decode returned -3", "ok"]


def test_stream_scores_only_new_files(spark):
    source, output, checkpoint = (new_path(spark, n) for n in ("in", "out", "progress"))
    schema = "article_id long, title string, text string"

    def add(ids):
        rows = [(i, f"title {i}", "text " * 10) for i in ids]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def run():
        IN.stream_scores(spark, source, output, checkpoint, Echo, files_per_batch=2)
        return spark.read.schema(SC.REPLY_SCHEMA).parquet(output)

    add(range(30))
    assert run().count() == 210
    assert run().count() == 210
    add(range(30, 50))
    out = run()
    assert out.count() == 350
    assert out.select("article_id", "task", "emotion").distinct().count() == 350
    assert glob.glob(f"{checkpoint}/commits/*")


class Counted:
    """Leaves a file for every load of the model, named by its process."""

    def __init__(self, folder):
        import os
        import uuid

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

    def __call__(self, prompts):
        return Failing()(prompts)


def test_a_kept_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)
    prompts = PR.prompt_fanout(article_frame(spark, ARTICLES * 20)).repartition(40)
    kept = SC.score_with_kept_model(prompts, lambda: Counted(folder), batch_rows=4)
    again = kept.collect()
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    # 40 tasks ran on fewer workers, and none of them loaded the model twice.
    assert 0 < len(loads) == len(set(loads)) < 40
    want = SC.score_batch(prompts, Failing).collect()
    assert sorted(map(str, again)) == sorted(map(str, want))
