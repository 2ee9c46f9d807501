"""The whole way from labelled CSV files to classified articles."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as V
from newsgauge.functions.prompts import prompt_fanout
from newsgauge.operators import classify, clean, models, scoring, stats
from newsgauge.session import new_path
from newsgauge.sources import sinks, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Mood:
    """Angrier replies to texts that shout."""

    def __call__(self, prompts):
        return [f"score 0.{8 if '!' in p.split('Text: ')[1] else 2}{len(p) % 10}" for p in prompts]


def test_csv_to_verdict(spark, tmp_path):
    for source in ("SiteA", "SiteB"):
        for label, mark in (("fake", "!"), ("real", ".")):
            lines = ["id,title,text,top_img,authors,publish_date,movies,images"]
            for i in range(12):
                lines.append(f'{i},"Title {i}","Body of ""article"" {"x" * i}{mark}\nsecond line",,,,,')
            lines.append("99,,short,,,,,")
            path = tmp_path / f"{source}_{label}_news_content.csv"
            path.write_text("\n".join(lines) + "\n")
    cleaned = clean.clean_articles(tables.scan_labelled_files(spark, str(tmp_path)))
    assert cleaned.columns == ["title", "text", "source", "label", "full_text"]
    stored = new_path(spark, "e2e-articles")
    sinks.sink_partitioned(clean.with_row_id(cleaned), stored)
    articles = tables.scan_parquet(spark, stored)
    assert articles.count() == 48 == articles.select("article_id").distinct().count()

    replies = scoring.score_batch(prompt_fanout(articles), Mood, partitions=3)
    stored = new_path(spark, "e2e-affect")
    sinks.sink_parquet(scoring.attach_profile(articles, scoring.affect_profile(replies)), stored)
    affect = tables.scan_parquet(spark, stored)
    assert affect.where(F.col("vreg").isNull()).count() == 0
    assert {(r.source, r.label, r.n) for r in stats.source_label_counts(affect).collect()} == {
        (s, x, 12) for s in ("SiteA", "SiteB") for x in V.LABELS
    }
    assert all(r.significant == "*" for r in stats.paper_table(affect).collect())

    model = models.train_classifier(affect)
    report = {r["class"]: r for r in classify.classification_report(models.predict(model, affect)).collect()}
    assert report["accuracy"].f1 == 1.0
    kmeans = models.kmeans_labels(affect, restarts=2)
    assert kmeans.where((F.col("pred") == 1) != (F.col("label") == "fake")).count() == 0
    distance = classify.affective_distance(affect)
    assert distance.where("cluster_pred <> label").count() == 0
