"""The pipeline: its stages on planted documents, and the entry without the operators."""

import os
import subprocess
import sys

import corpus_pipeline as C
from newsgauge.llm import queries
from newsgauge.session import materialize
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_quality import brute as counts
from tests.llm.test_tokens import expected_pieces

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.dtypes
    kept = {}
    texts = {"documents": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in C.STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        if name != C.STAGES[-1][0]:
            assert docs.dtypes == columns
            texts[name] = {r.doc_id: r.text for r in rows}
        kept[name] = rows
    assert [n for n, _ in C.STAGES] == [
        "quality_rules", "near_duplicates", "personal_data", "domain_mix", "best_fit_packing"
    ]

    for doc_id, text in texts["documents"].items():
        n_words, *_, repeated = counts(text)
        if n_words < 50 or 100 * repeated > 50 * n_words:
            assert doc_id not in texts["quality_rules"]
    want = {g[4] for g in groups(list(texts["quality_rules"].items()))}
    assert set(texts["near_duplicates"]) == want
    assert set(texts["personal_data"]) == want
    changed = [i for i in want if texts["personal_data"][i] != texts["near_duplicates"][i]]
    assert changed and all("<" in texts["personal_data"][i] for i in changed)
    assert set(texts["domain_mix"]) <= want
    pieces = sorted(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in kept["best_fit_packing"]
    )
    assert pieces == sorted(expected_pieces(sorted(texts["domain_mix"].items())))
    run = C.run(spark, sf_dir)
    assert run.columns == docs.columns and run.count() == len(pieces)


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_entry_without_the_operators(tmp_path):
    """As after the operators' folders have been deleted."""
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "newsgauge", ".git"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.mkdir(tmp_path / "newsgauge")
    for name in os.listdir(os.path.join(ROOT, "newsgauge")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "newsgauge", name), tmp_path / "newsgauge" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    with open(os.path.join(ROOT, "__spark_entry__.py")) as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80; " \
        "assert not any(n.startswith('op') or n == 'pipeline' for n in q)"  # fmt: skip
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True,
                   env={**os.environ, "PYTHONPATH": str(tmp_path)})
