"""Column expressions for article text and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgauge.functions.fixed_values import (
    DEFAULT_CONFIDENCE,
    DEFAULT_VERDICT,
    EMOTIONS,
    EXPLANATION_CHARS,
    FLOAT_PATTERN,
    INT_PATTERN,
    SNIPPET,
    SNIPPET_CHARS,
    WHITESPACE,
)


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def full_text(title: Column, text: Column) -> Column:
    """``title. text``: first dots and spaces leave the ends, then whitespace."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))
    return strip(F.btrim(joined, F.lit(". ")))


def truncate(c: Column, max_chars: int) -> Column:
    """The first ``max_chars`` code points."""
    return F.substring(c, 1, max_chars)


def parse_float(raw: Column, default: float = 0.5) -> Column:
    """First number in a reply, clamped to 0..1. A null reply (no reply at all) stays null."""
    number = F.regexp_extract(raw, FLOAT_PATTERN, 0).try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(float(default)))))
    return F.when(raw.isNotNull(), clamped)


def parse_voc(raw: Column) -> Column:
    """First integer in a reply, clamped to -3..3; through double, as int would overflow."""
    number = F.regexp_extract(raw, INT_PATTERN, 0).try_cast("double")
    clamped = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.coalesce(number, F.lit(0.0))))
    return F.when(raw.isNotNull(), clamped.cast("int"))


def emotion_bits(raw: Column) -> Column:
    """Emotions named anywhere in a reply, one bit each in vocabulary order."""
    low = F.lower(raw)
    bits = [F.when(F.contains(low, F.lit(e)), 1 << i).otherwise(0) for i, e in enumerate(EMOTIONS)]
    return F.when(raw.isNotNull(), sum(bits[1:], bits[0]))


def emotion_names(bits: Column) -> Column:
    """The emotions of ``emotion_bits`` as an array."""
    names = F.array(*[F.lit(e) for e in EMOTIONS])
    chosen = F.filter(names, lambda e, i: F.getbit(bits, i) == 1)
    return F.when(bits.isNotNull(), chosen)


def parse_ec(raw: Column) -> Column:
    """Emotions named anywhere in a reply, in vocabulary order."""
    return emotion_names(emotion_bits(raw))


def read_ec_repr(c: Column) -> Column:
    """An emotion list from its text form in a CSV cell: ``['anger', 'fear']``."""
    return F.from_json(c, "array<string>")


def clean_query(raw: Column) -> Column:
    """A search query without surrounding whitespace, then double, then single quotes."""
    return F.btrim(F.btrim(strip(raw), F.lit('"')), F.lit("'"))


def snippet(url: Column, title: Column, content: Column) -> Column:
    """One evidence record as text."""
    values = {"url": url, "title": title, "content": truncate(content, SNIPPET_CHARS)}
    return fill_template(SNIPPET, **values)


def fill_template(template: str, **columns: Column) -> Column:
    """``concat`` of a template's fixed parts and the columns named in its braces."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + name + "}"), name) for name in columns]
        hits = [hit for hit in hits if hit[0] >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(columns[name], F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def verdict_object(raw: Column) -> Column:
    """The JSON object in a reply, from the first ``{`` to the last ``}``, as a variant.

    It is wrapped as ``{"body": .., "end": 1}``, as text after an object would be ignored.
    """
    start = F.instr(raw, "{")
    last = F.instr(F.reverse(raw), "}")
    end = F.when(last > 0, F.length(raw) - last + 1).otherwise(F.lit(0))
    body = F.when((start > 0) & (end > start), F.substring(raw, start, end - start + 1))
    return F.try_parse_json(F.concat(F.lit('{"body":'), body, F.lit(',"end":1}')))


def verdict_fields(raw: Column, wrapped: Column) -> Column:
    """Struct ``(verdict, confidence, explanation)`` of a reply and its ``verdict_object``.

    Without exactly one valid object every field keeps its default. A confidence that is no
    number keeps 0.5, and the explanation then stays the start of the reply, while the verdict
    is kept.
    """
    whole = (F.size(F.try_variant_get(wrapped, "$", "map<string,variant>")) == 2) & (
        F.try_variant_get(wrapped, "$.end", "int") == 1
    )
    parsed = F.when(whole, F.try_variant_get(wrapped, "$.body", "variant"))

    def present(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "variant").isNotNull()

    def string_or(name: str, default: Column) -> Column:
        value = F.try_variant_get(parsed, f"$.{name}", "string")
        return F.when(present(name), value).otherwise(default)

    number = F.try_variant_get(parsed, "$.confidence", "double")
    number = F.when(~F.isnan(number), number)
    start_of_reply = truncate(raw, EXPLANATION_CHARS)
    return F.struct(
        string_or("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
        F.coalesce(number, F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.when(present("confidence") & number.isNull(), start_of_reply)
        .otherwise(string_or("explanation", start_of_reply))
        .alias("explanation"),
    )


def verdict_sources(wrapped: Column) -> Column:
    """Struct of the optional source lists in a ``verdict_object``; null where absent."""
    names = ["supporting_sources", "contradicting_sources"]
    return F.struct(
        *[F.try_variant_get(wrapped, f"$.body.{n}", "array<string>").alias(n) for n in names]
    )


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def page_content(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", " ")
