"""Personal data in texts: base patterns, and weak supervision for further spans.

Everything that touches texts is DataFrame expressions. Base spans are the matches of four
patterns that pass their checks. Other candidates are matches that fail their check, telephone
numbers without a plus, and addresses with a written-out at sign. Four labelers vote on every
candidate (1 personal, 0 not, null abstains): the strict pattern, a format check, a gazetteer
(top-level domains, issuer prefixes, reserved networks, area codes) and the words before it.
Expectation-maximisation over the counts of vote patterns, a table of at most 4 x 81 rows whatever
the number of documents, estimates how reliable each labeler is for each kind; a logistic span
classifier is trained on its posteriors, and adds the candidates it finds personal that overlap no
base span. Base spans always stay.

Defined results: a null text is an empty text without spans; a null doc_id stays null; repeated
rows are judged alike; with no candidates there is nothing to learn and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context")
ROUNDS = 50
CONTEXT_CHARS = 32

# The base patterns. Possessive repeats and the look-behinds change no match, they only keep the
# search linear: a match starts where a run of its first class starts, or where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,63}+"
    r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[a-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
_NEEDS = {"email": "@", "phone": "+"}
_LOOSE_NEEDS = {"email": r"(?i)[(\[]at[)\]]", "phone": r"[0-9]{3}[ .-][0-9]{4}"}

# Fixed values of the gazetteer.
DOMAINS = "com org net edu gov mil int info biz io de fr es uk it nl eu us ca au ch at".split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
RESERVED = r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|2[2-5][0-9])\."
AREAS = r"^1?[2-9][0-9]{9}$|^(3[0-9]|4[0-9])[0-9]{8,}$"
# Words that speak for or against a kind, in the text before it.
FOR = {
    "email": r"(mail|contact|write to|address|correo|courriel|kontakt)",
    "ip": r"(\bip\b|server|host|network|login|address|red|réseau)",
    "card": r"(card|visa|mastercard|credit|debit|tarjeta|carte|karte|payment)",
    "phone": r"(phone|call|tel|mobile|fax|llame|appel|anruf|whatsapp)",
}
AGAINST = r"(version|isbn|issn|order|invoice|token|hash|serial|build|chapter|section)"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(
            F.when(twice > 9, twice - 9).otherwise(twice)
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0)


def _votes(kind: str, match: Column, before: Column, strict: Column) -> list[Column]:
    """Votes of the labelers, in their order."""
    digits, near = _digits(match), F.lower(before)
    if kind == "email":
        domain = F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1))
        check = _vote(match.rlike(r"[A-Za-z]{2,}$"), F.lit(True))
        known = _vote(domain.isin(DOMAINS), F.lit(True))
    elif kind == "ip":
        check = _vote(_valid(kind, match), F.lit(True))
        known = _vote(~match.rlike(RESERVED), F.lit(True))
    elif kind == "card":
        check = _vote(_valid(kind, match), F.lit(True))
        known = _vote(digits.rlike(ISSUERS), F.lit(True))
    else:
        check = _vote(F.length(digits).between(10, 15), F.lit(True))
        known = _vote(digits.rlike(AREAS), F.lit(True))
    context = _vote(near.rlike(FOR[kind]), near.rlike(AGAINST))
    return [_vote(strict, F.lit(True)), check, known, context]


_FOUND = "array<struct<start int, end int, place int, kind string, base boolean, votes string>>"


def _matches(kind: str, pattern: str, strict: bool) -> Column:
    """The candidates among all matches of a pattern, with code point offsets.

    What lies between matches and the matches themselves give the offsets. Both arrays are
    walked once; lambdas see nothing from outside, as that would be computed for each element.
    """
    parts = F.arrays_zip(
        F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("match"),
        F.split("_text", pattern, -1).alias("gap"),
    )

    def step(state: Column, part: Column) -> Column:
        match = part["match"]
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(match)
        votes = _votes(kind, match, F.right(part["gap"], F.lit(CONTEXT_CHARS)), F.lit(strict))
        one = F.struct(
            start.alias("start"),
            end.alias("end"),
            F.lit(KINDS.index(kind)).alias("place"),
            F.lit(kind).alias("kind"),
            (_valid(kind, match) if strict else F.lit(False)).alias("base"),
            F.concat(*[F.coalesce(v.cast("string"), F.lit("-")) for v in votes]).alias("votes"),
        )
        # Short runs of digits are no candidates; the text after the last match has no match.
        counts = match.isNotNull()
        if kind == "card":
            counts = F.length(_digits(match)).between(14, 19)
        more = F.concat(state["found"], F.array(one).cast(_FOUND))
        return F.struct(
            end.alias("at"), F.when(counts, more).otherwise(state["found"]).alias("found")
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))
    return F.aggregate(parts, begin, step, lambda state: state["found"])


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_found``: all candidates, those that are base spans marked."""
    none = F.array().cast(_FOUND)
    digit = F.col("_text").rlike("[0-9]")
    found = []
    for kind in KINDS:
        needed = F.contains("_text", F.lit(_NEEDS[kind])) if kind in _NEEDS else digit
        found.append(F.when(needed, _matches(kind, PATTERNS[kind], True)).otherwise(none))
    for kind in LOOSE:
        needed = F.col("_text").rlike(_LOOSE_NEEDS[kind])
        found.append(F.when(needed, _matches(kind, LOOSE[kind], False)).otherwise(none))
    return (
        docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("_found", F.concat(*found))
        .drop("_text")
    )


def reliabilities(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) by expectation-maximisation, for every kind on its own.

    Labelers are independent given the truth; each has a rate of positive votes for personal and
    for other spans, started where a labeler is right four times out of five.
    """
    result = {}
    for kind in {k for k, _ in counts}:
        patterns = {v: n for (k, v), n in counts.items() if k == kind}
        share = 0.5
        rates = [{1: 0.8, 0: 0.2} for _ in LABELERS]
        posterior: dict[str, float] = {}
        for _ in range(ROUNDS):
            for votes in patterns:
                odds = {1: share, 0: 1 - share}
                for rate, vote in zip(rates, votes):
                    for truth in (0, 1):
                        if vote != "-":
                            odds[truth] *= rate[truth] if vote == "1" else 1 - rate[truth]
                posterior[votes] = odds[1] / (odds[0] + odds[1])
            total = sum(patterns.values())
            share = (1 + sum(n * posterior[v] for v, n in patterns.items())) / (2 + total)
            for i, rate in enumerate(rates):
                for truth in (0, 1):
                    weight = {v: n * (posterior[v] if truth else 1 - posterior[v])
                              for v, n in patterns.items() if v[i] != "-"}
                    said = sum(w for v, w in weight.items() if v[i] == "1")
                    # One right and, less so, one wrong vote each are assumed beforehand.
                    prior = 0.8 if truth else 0.2
                    rate[truth] = (said + 4 * prior) / (sum(weight.values()) + 4)
        result.update({(kind, v): p for v, p in posterior.items()})
    return result


def _features(votes: str) -> list[float]:
    return [1.0, *({"1": 1.0, "0": -1.0, "-": 0.0}[v] for v in votes)]


def span_classifier(
    counts: dict[tuple[str, str], int], posterior: dict[tuple[str, str], float]
) -> dict[str, list[float]]:
    """Logistic weights per kind, fitted to the posteriors by gradient steps."""
    weights = {}
    for kind in {k for k, _ in counts}:
        rows = [(_features(v), n, posterior[k, v]) for (k, v), n in counts.items() if k == kind]
        total = sum(n for _, n, _ in rows)
        w = [0.0] * (1 + len(LABELERS))
        for _ in range(2000):
            slope = [0.01 * x for x in w]
            for x, n, p in rows:
                score = sum(a * b for a, b in zip(w, x))
                gap = 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - p
                slope = [s + gap * n / total * a for s, a in zip(slope, x)]
            w = [a - 0.5 * s for a, s in zip(w, slope)]
        weights[kind] = w
    return weights


def learn(docs: DataFrame) -> dict[tuple[str, str], float]:
    """Probability that a candidate of a kind with given votes is personal."""
    rows = (
        candidates(docs.select("text"))
        .select(F.explode("_found").alias("c"))
        .groupBy("c.kind", "c.votes")
        .agg(F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    counts = {(r["kind"], r["votes"]): r["rows"] for r in rows}
    weights = span_classifier(counts, reliabilities(counts))
    return {
        (kind, votes): 1
        / (1 + math.exp(-sum(a * b for a, b in zip(weights[kind], _features(votes)))))
        for kind, votes in counts
    }


def find_spans(docs: DataFrame, learned: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: sorted arrays of (start, place, end, kind)."""
    learned = learn(docs) if learned is None else learned
    personal = sorted(f"{k}:{v}" for (k, v), p in learned.items() if p >= 0.5)
    accepted = F.array(*[F.lit(p) for p in personal]).cast("array<string>")

    def shape(c: Column) -> Column:
        return F.struct(*[c[name].alias(name) for name in ("start", "place", "end", "kind")])

    def overlaps(c: Column) -> Column:
        return F.exists(
            F.col("_base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        )

    added = F.filter(
        F.col("_found"),
        lambda c: ~c["base"]
        & F.array_contains(accepted, F.concat(c["kind"], F.lit(":"), c["votes"]))
        & ~overlaps(c),
    )
    return (
        candidates(docs)
        .withColumn(
            "_base", F.array_sort(F.transform(F.filter("_found", lambda c: c["base"]), shape))
        )
        .withColumn(
            "_spans",
            F.array_sort(F.array_distinct(F.concat("_base", F.transform(added, shape)))),
        )
        .drop("_found")
    )


def _listed(spans: str) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def private_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, one row per document."""
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def count(kind: str) -> Column:
        of_kind = F.filter("_base", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(_listed("_base"), 256).alias("base_sha256"),
        _listed("_spans").alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and ``n_chars`` renewed.

    Where spans overlap, one tag, the first one's, stands for all of them.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = find_spans(docs.select(F.col("text").cast("string").alias("text"), whole))

    def step(state: Column, s: Column) -> Column:
        gap = s["start"] - state["at"]
        fresh = F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.concat(
                state["text"],
                F.substring(F.col("text"), state["at"] + 1, gap),
                F.lit("<"), F.upper(s["kind"]), F.lit(">"),
            ).alias("text"),
        )
        covered = F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), state["text"].alias("text")
        )
        return F.when(gap >= 0, fresh).otherwise(covered)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    masked = F.aggregate(
        "_spans",
        start,
        step,
        lambda s: F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.lit(2147483647))),
    )
    text = F.when(F.size("_spans") > 0, masked).otherwise(F.col("text"))
    changed = F.size("_spans") > 0
    renewed = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        count = F.char_length("_masked").cast(kind)
        renewed["n_chars"] = F.when(changed, count).otherwise(F.col("_row.n_chars"))
    return found.select(text.alias("_masked"), "_spans", "_row").select(
        *[renewed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    )
