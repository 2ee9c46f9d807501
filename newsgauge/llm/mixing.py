"""Mixing by soft membership: how often each document should be used so that domains meet targets.

A labelled table gives three domains: ``toxic``, and of the rest ``high`` and ``low`` quality. A
naive Bayes classifier over the presence of words and of a few writing habits, fitted on a bounded
sample of labelled documents, predicts each document's domain posteriors. Nonnegative rates r then
minimise, with tokens t, posteriors p and target totals T (as shares of all tokens),

    sum_k (sum_d r_d t_d p_dk - T_k)^2 + RIDGE * sum_d t_d (r_d - 1)^2

by projected gradient steps. The ridge is separable, so a gradient step of length 1 / RIDGE from
any r lands on ``r_d = max(0, 1 - p_d . y)``, where y are the scaled residuals of the domains. Only y, one
number a domain, has to be kept between passes; each pass is one aggregate over all documents,
which gives the residuals and, to scale the step, the Gram matrix of the documents in use.

Everything on the way of the documents is DataFrame expressions. What reaches the driver are the
model, at most ``VOCABULARY`` words, and sums by domain.

Defined results: a null text is an empty text; a document without tokens has the prior as
posterior, takes no part in the sums and still gets its rate; repeated rows count each; a document
with several label rows takes the worst of them; without any label every document counts as high.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.session import materialize

DOMAINS = ("high", "low", "toxic")
WEIGHTS = {"high": 0.9, "low": 0.08, "toxic": 0.02}
SAMPLE = 20_000
VOCABULARY = 128
LEAST_RATIO = math.log(2)
# In nats; among a hundred thousand words some reach half of it by chance.
LEAST_GAIN = 16.0
RIDGE = 1e-5
MIX_RIDGE = 0.02
PASSES = 40


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def _level(share: Column, name: str) -> Column:
    """A token for the size of a share: none, some, much."""
    return F.when(share > 0.2, f"{name}:2").when(share > 0.05, f"{name}:1").otherwise(f"{name}:0")


def _described(docs: DataFrame) -> DataFrame:
    """Add ``_words``, ``_symbols`` and ``_loud`` (runs of capitals) to the documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_text", text).withColumns(
        {
            "_words": F.filter(_words(F.col("_text")), lambda w: w != ""),
            "_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]{1,3}")),
            "_loud": F.regexp_count("_text", F.lit(r"[A-Z]{2,}")),
        }
    )


def _habits() -> Column:
    size = F.greatest(F.size("_words"), F.lit(1))
    return F.array(
        _level(F.col("_symbols") / size, "#symbols"), _level(F.col("_loud") / size, "#loud")
    )


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").otherwise("high")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``, one row per labelled document."""
    return (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .where("quality is not null or toxic is not null")
        .select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    )


@dataclass(frozen=True)
class Model:
    """For each domain the log odds of a text without any of the words, and what each adds."""

    prior: tuple[float, ...]
    words: tuple[str, ...]
    ratios: tuple[tuple[float, ...], ...]

    def evidence(self) -> Column:
        """The ratios of the model's words in ``_words`` and of the habits, as rows of an array."""
        known = F.array(*[F.lit(w) for w in self.words]).cast("array<string>")
        ratios = F.array(*[F.array(*[F.lit(x) for x in r]) for r in self.ratios])
        table = F.map_from_arrays(known, ratios)
        present = F.array_intersect(F.concat("_words", _habits()), known)
        return F.transform(present, lambda w: F.element_at(table, w))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Naive Bayes over the words that tell the domains apart, from ``sample`` labelled documents."""
    some = (
        labelled_domains(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )  # bounded by the parameter, so it may be broadcast
    rows = _described(
        docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    ).select("domain", F.array_distinct(F.concat("_words", _habits())).alias("words"))
    by_domain = lambda: [
        F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS
    ]
    sizes = rows.agg(*by_domain()).first()
    total = [sizes[d] for d in DOMAINS]
    everything = sum(total)
    if not everything:
        return Model((0.0, -50.0, -50.0), (), ())

    def chance(d: str, k: int) -> Column:
        return (F.col(d) + 0.5) / (total[k] + 1.0)

    seen = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    mean = (seen + 0.5) / (everything + 1.0)
    ratios = [F.log(chance(d, k) / mean) for k, d in enumerate(DOMAINS)]
    gain = sum(
        (F.col(d) * r for d, r in zip(DOMAINS[1:], ratios[1:])), F.col(DOMAINS[0]) * ratios[0]
    )
    # Words that speak for a domain; a language's common words would only tell languages apart.
    best = (
        rows.select("domain", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(*by_domain())
        .where((gain >= LEAST_GAIN) & (F.greatest(*ratios) >= LEAST_RATIO))
        .select("word", *[chance(d, k).alias(f"c_{d}") for k, d in enumerate(DOMAINS)], gain.alias("gain"))
        .orderBy(F.desc("gain"), "word")
        .limit(VOCABULARY)
        .collect()
    )
    absent = [sum(math.log(1 - r[f"c_{d}"]) for r in best) for d in DOMAINS]
    return Model(
        tuple(math.log((n + 0.5) / (everything + 1.5)) + a for n, a in zip(total, absent)),
        tuple(r["word"] for r in best),
        tuple(
            tuple(math.log(r[f"c_{d}"] / (1 - r[f"c_{d}"])) for d in DOMAINS) for r in best
        ),
    )


def posteriors(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of the documents, ``n_tokens`` (words of letters) and ``p_<domain>``."""
    evidence = model.evidence() if model.words else F.array().cast("array<array<double>>")
    found = _described(docs).select(
        *columns, F.size("_words").cast("long").alias("n_tokens"), evidence.alias("_evidence")
    )
    start = F.array(*[F.lit(x) for x in model.prior])
    summed = F.aggregate("_evidence", start, lambda s, r: F.zip_with(s, r, lambda a, b: a + b))
    logits = found.select(*columns, "n_tokens", summed.alias("_sums"))
    narrow = logits.select(
        *columns,
        "n_tokens",
        *[F.element_at("_sums", k + 1).alias(f"_s_{d}") for k, d in enumerate(DOMAINS)],
    )
    top = F.greatest(*[F.col(f"_s_{d}") for d in DOMAINS])
    powers = narrow.withColumns({f"_e_{d}": F.exp(F.col(f"_s_{d}") - top) for d in DOMAINS})
    total = sum((F.col(f"_e_{d}") for d in DOMAINS[1:]), F.col(f"_e_{DOMAINS[0]}"))
    return powers.select(
        *columns, "n_tokens", *[(F.col(f"_e_{d}") / total).alias(f"p_{d}") for d in DOMAINS]
    )


def rate(y: list[float] | np.ndarray) -> Column:
    """The rate of a document for given scaled residuals."""
    step = sum(
        (F.lit(float(v)) * F.col(f"p_{d}") for d, v in zip(DOMAINS[1:], y[1:])),
        F.lit(float(y[0])) * F.col(f"p_{DOMAINS[0]}"),
    )
    return F.greatest(F.lit(0.0), F.lit(1.0) - step)


def _sums(scored: DataFrame, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the rates of y, and the Gram matrix of documents in use."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    r, t = rate(y), F.col("n_tokens")
    k = len(DOMAINS)
    totals = [F.sum(r * t * p[i]).alias(f"e{i}") for i in range(k)]
    grams = [
        F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}{j}")
        for i in range(k)
        for j in range(i, k)
    ]
    row = scored.agg(*totals, *grams).first()
    value = lambda name: float(row[name] or 0.0)
    gram = np.array([[value(f"g{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)])
    return np.array([value(f"e{i}") for i in range(k)]), gram


def solve(
    scored: DataFrame,
    targets: np.ndarray | None = None,
    weights: dict[str, float] | None = None,
    ridge: float | np.ndarray = RIDGE,
) -> np.ndarray:
    """The scaled residuals y of the best rates for target totals.

    Targets are tokens per domain; with ``weights`` instead, that share of all tokens each. A
    ``ridge`` for each domain divides the square of its residual in the sum that is minimised.
    ``scored`` is read once a pass and should be stored.
    """
    k = len(DOMAINS)
    ridge = np.broadcast_to(np.asarray(ridge, dtype=float), (k,))
    # A domain of any share is solved to the same accuracy.
    enough = 1e-10 * np.minimum(1.0, ridge / RIDGE)
    y = np.zeros(k)
    expected, gram = _sums(scored, y)
    total = expected.sum()
    if not total:
        return y
    if targets is None:
        targets = total * np.array([weights[d] for d in DOMAINS])
    goal = targets / total

    def residual(y: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return expected / total - goal - ridge * y

    def length(off: np.ndarray) -> float:
        return np.linalg.norm(off / np.sqrt(ridge))

    off = residual(y, expected)
    for _ in range(PASSES):
        if (np.abs(off) < enough).all():
            break
        step = np.linalg.solve(gram / total + np.diag(ridge), off)
        size = 1.0
        while True:
            trial = y + size * step
            expected, trial_gram = _sums(scored, trial)
            trial_off = residual(trial, expected)
            if length(trial_off) < length(off) or size < 1 / 64:
                break
            size /= 2
        y, off, gram = trial, trial_off, trial_gram
    return y


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``doc_id, n_tokens, p_high, p_low, p_toxic, rate``: rates that move the corpus to the
    weights, at its present number of tokens."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = materialize(
        docs.sparkSession, posteriors(ids, fit(ids, labels), ["doc_id"]), "posteriors"
    )
    return scored.withColumn("rate", rate(solve(scored, weights=weights)))


def solve_without(
    scored: DataFrame, without: tuple[str, ...], ridge: float = MIX_RIDGE
) -> np.ndarray:
    """The scaled residuals y for the present totals of all domains, and zero for ``without``.

    The ridge of a domain is ``ridge`` times its own expected share, and the share that it has in
    common with the domains of the other side (wanted or not), which no rate can tell apart. So
    y of an unwanted domain is about 1 / (1 + ridge) whether it has half of all tokens or one
    document, and a document's rate is about one less its unwanted posterior.
    """
    expected, gram = _sums(scored, np.zeros(len(DOMAINS)))
    kept = np.array([d not in without for d in DOMAINS])
    common = np.where(kept[:, None] != kept[None, :], gram, 0.0).sum(axis=1)
    ridges = (ridge * expected + common) / (expected.sum() or 1.0)
    return solve(
        scored, np.where(kept, expected, 0.0), ridge=np.where(ridges > 0, ridges, ridge)
    )


def mix(
    docs: DataFrame,
    labels: DataFrame,
    without: tuple[str, ...] = ("toxic",),
    ridge: float = MIX_RIDGE,
    model: Model | None = None,
) -> DataFrame:
    """The rows of ``docs`` whose rate rounds to one or more, each once.

    Targets are the present totals of all domains, and zero for those in ``without``, with the
    ridges of ``solve_without``: documents that have a little of an unwanted domain, as all have,
    keep rates near one, and those that mostly belong to it get rates near zero, however few they
    are. Without a ``model`` one is fitted on the labelled rows of ``docs``.
    """
    columns = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(docs.columns)]
    held = docs.select(F.col("doc_id"), F.col("text"), *columns)
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    if model is None:
        model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    narrow = materialize(docs.sparkSession, posteriors(held.select("text"), model, []), "posteriors")
    y = solve_without(narrow, without, ridge)
    scored = posteriors(held, model, names).where(rate(y) >= 0.5)
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
