"""The queries as DuckDB SQL over the same tables."""

from __future__ import annotations

import re

from newsgauge.functions import fixed_values as V


def quoted(text: str) -> str:
    """A SQL string literal; characters outside printable ASCII by code."""
    parts, plain = [], ""
    for ch in text:
        if " " <= ch <= "~" or ch.isalpha() or ch == "—":
            plain += ch.replace("'", "''")
        else:
            parts += [f"'{plain}'"] if plain else []
            parts.append(f"chr({ord(ch)})")
            plain = ""
    parts += [f"'{plain}'"] if plain else []
    return "(" + " || ".join(parts or ["''"]) + ")"


def template(pattern: str, **columns: str) -> str:
    """A prompt template as a SQL concatenation."""
    pieces = [pattern]
    for name, column in columns.items():
        split: list = []
        for piece in pieces:
            if isinstance(piece, tuple):
                split.append(piece)
                continue
            for i, part in enumerate(piece.split("{" + name + "}")):
                if i:
                    split.append((column,))
                split.append(part)
        pieces = split
    sql = [f"coalesce({p[0]}, '')" if isinstance(p, tuple) else quoted(p) for p in pieces if p]
    return "(" + " || ".join(sql) + ")"


WS = quoted(V.WHITESPACE)
NA = ", ".join(quoted(s) if s else "''" for s in V.NA_STRINGS)


def _score(i: int) -> str:
    return (
        "greatest(CAST(0 AS double), least(CAST(1 AS double), "
        f"CAST(0.5 AS double) + CAST(2 AS double) * CAST(embedding[{i}] AS double)))"
    )


def _reply(n: str) -> str:
    return f"""CASE ({n}) % 6
      WHEN 0 THEN concat('Score: 0.', CAST(({n}) % 97 AS varchar))
      WHEN 1 THEN concat('-', CAST(({n}) % 5 AS varchar), ' overall')
      WHEN 2 THEN 'no score'
      WHEN 3 THEN concat('.', CAST(({n}) % 9 AS varchar), ' out of 1')
      WHEN 4 THEN '99999999999999999999999 Anger, JOYFUL and distrust'
      ELSE '' END"""


def _parse_float(raw: str) -> str:
    return (
        f"CASE WHEN {raw} IS NOT NULL THEN greatest(CAST(0 AS double), least(CAST(1 AS double), "
        f"coalesce(TRY_CAST(regexp_extract({raw}, '{V.FLOAT_PATTERN}') AS double), "
        "CAST(0.5 AS double)))) END"
    )


def _parse_voc(raw: str) -> str:
    return (
        f"CASE WHEN {raw} IS NOT NULL THEN CAST(greatest(-3, least(3, coalesce(TRY_CAST("
        f"regexp_extract({raw}, '{V.INT_PATTERN}') AS double), 0))) AS int) END"
    )


def _parse_ec(raw: str) -> str:
    emotions = ", ".join(f"'{e}'" for e in V.EMOTIONS)
    return f"array_to_string(list_filter([{emotions}], lambda e: contains(lower({raw}), e)), ',')"


VIEWS = {
    "articles": """SELECT d.doc_id AS article_id, d.source, d.lang,
        split_part(d.text, chr(10), 1) AS title, d.text,
        CASE WHEN l.toxic = 1 THEN 'fake' WHEN l.toxic = 0 THEN 'real' END AS label
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "cleaned": f"""SELECT *, trim(trim(coalesce(title, '') || '. ' || coalesce(text, ''), '. '), {WS})
        AS full_text FROM articles""",
    "affect": f"""SELECT vec_id AS article_id,
        CASE WHEN vec_id % 3 = 0 THEN 'domA' ELSE 'domB' END AS source,
        CASE WHEN label % 2 = 0 THEN 'fake' ELSE 'real' END AS label,
        CASE WHEN vec_id % 17 = 0 THEN NULL ELSE {_score(1)} END AS vreg,
        {_score(2)} AS eireg_anger, {_score(3)} AS eireg_fear,
        {_score(4)} AS eireg_joy, {_score(5)} AS eireg_sadness,
        CAST(greatest(-3, least(3, floor(CAST(embedding[6] AS double) * 16))) AS int) AS voc
      FROM embeddings""",
    "filled": """SELECT * REPLACE (coalesce(vreg, CAST(0.5 AS double)) AS vreg),
        CASE WHEN label = 'fake' THEN 1 ELSE 0 END AS y FROM affect""",
    "replies": f"SELECT doc_id AS article_id, {_reply('n_chars')} AS raw FROM documents",
    "task_replies": " UNION ALL ".join(
        f"SELECT doc_id AS article_id, '{task}' AS task, {emotion} AS emotion, "
        f"{_reply(f'n_chars + {i}')} AS raw FROM documents"
        for i, (task, emotion) in enumerate(
            [("vreg", "NULL"), ("voc", "NULL")]
            + [("eireg", f"'{e}'") for e in V.INTENSITY_EMOTIONS]
            + [("ec", "NULL")]
        )
    ),
    "verdict_raw": """SELECT page_id AS article_id, CASE page_id % 5
        WHEN 0 THEN concat('Sure: {"verdict": "SUPPORTED", "confidence": 0.',
          CAST(page_id % 89 AS varchar), ', "explanation": "e', CAST(page_id AS varchar), '"} done')
        WHEN 1 THEN '{"verdict": "CONTRADICTED", "confidence": "0.9"}'
        WHEN 2 THEN 'I cannot tell.'
        WHEN 3 THEN '{"verdict": "SUPPORTED", "confidence": "high", "explanation": "z"}'
        ELSE '} broken {' END AS raw FROM pages""",
    "verdicts": f"""SELECT article_id,
        CASE WHEN j IS NULL THEN '{V.DEFAULT_VERDICT}'
             ELSE coalesce(j->>'$.verdict', '{V.DEFAULT_VERDICT}') END AS verdict,
        coalesce(TRY_CAST(j->>'$.confidence' AS double), CAST(0.5 AS double)) AS confidence,
        CASE WHEN j IS NULL OR (json_extract(j, '$.confidence') IS NOT NULL
               AND TRY_CAST(j->>'$.confidence' AS double) IS NULL) THEN left(raw, 200)
             ELSE coalesce(j->>'$.explanation', left(raw, 200)) END AS explanation
      FROM (SELECT article_id, raw, CASE WHEN json_valid(body) THEN CAST(body AS json) END AS j
            FROM (SELECT *, nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS body
                  FROM verdict_raw) x) y""",
    "query_raw": """SELECT page_id AS article_id, CASE page_id % 3
        WHEN 0 THEN ' "' || title || '"' || chr(10)
        WHEN 1 THEN '"''' || title || '''"' ELSE title END AS raw
      FROM corpus""",
    "queries": f"""SELECT article_id,
        trim(trim(trim(raw, {WS}), '"'), '''') AS query FROM query_raw""",
    "corpus": """SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
        regexp_replace(html, '<[^>]*>', ' ', 'g') AS content FROM pages""",
    "matches": """WITH dt AS (SELECT DISTINCT article_id, tok FROM (SELECT article_id,
          unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tok FROM articles) x),
        pt AS (SELECT DISTINCT page_id, tok FROM (SELECT page_id,
          unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS tok FROM corpus) x),
        df AS (SELECT tok, count(*) AS df FROM pt GROUP BY tok),
        n AS (SELECT count(*) AS n FROM pages),
        sc AS (SELECT article_id, page_id, round(sum(ln(CAST(n AS double) / df)), 6) AS score
          FROM dt JOIN pt USING (tok) JOIN df USING (tok) CROSS JOIN n
          GROUP BY article_id, page_id HAVING round(sum(ln(CAST(n AS double) / df)), 6) > 0)
      SELECT article_id, page_id, score, rank FROM (SELECT *, CAST(row_number() OVER
          (PARTITION BY article_id ORDER BY score DESC, page_id) AS int) AS rank FROM sc) y
      WHERE rank <= 10""",
    "evidence": f"""SELECT article_id,
        string_agg({template(V.SNIPPET, url='url', title='title', content='left(content, 800)')},
          {quoted(V.SNIPPET_SEPARATOR)} ORDER BY rank) AS evidence_text,
        string_agg(url, ',' ORDER BY rank) AS sources
      FROM matches JOIN corpus USING (page_id) GROUP BY article_id""",
    "neighbours": """SELECT article_id, neighbour_id, cosine, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY article_id
          ORDER BY cosine DESC, neighbour_id) AS int) AS rank
        FROM (SELECT a.vec_id AS article_id, b.vec_id AS neighbour_id, round(
            list_dot_product(CAST(a.embedding AS double[]), CAST(b.embedding AS double[]))
            / sqrt(list_dot_product(CAST(a.embedding AS double[]), CAST(a.embedding AS double[])))
            / sqrt(list_dot_product(CAST(b.embedding AS double[]), CAST(b.embedding AS double[]))),
            9) AS cosine
          FROM embeddings a JOIN embeddings b ON a.label <> b.label) s) r
      WHERE rank <= 4""",
    "raw_articles": """SELECT article_id, source, title, coalesce(label, 'na') AS label,
        CASE WHEN article_id % 5 = 0 THEN source ELSE 'na' END AS note FROM articles""",
    "no_sentinel": """SELECT article_id, nullif(source, 'na') AS source, nullif(title, 'na') AS title,
        nullif(label, 'na') AS label, nullif(note, 'na') AS note FROM raw_articles""",
    "prompts": " UNION ALL ".join(
        f"SELECT article_id, '{task}' AS task, {emotion} AS emotion, {prompt} AS prompt FROM cleaned"
        for task, emotion, prompt in [
            ("vreg", "NULL", template(V.VREG_PROMPT, text="left(full_text, 350)")),
            ("voc", "NULL", template(V.VOC_PROMPT, text="left(full_text, 350)")),
            *[
                ("eireg", f"'{e}'", template(V.EIREG_PROMPT, text="left(full_text, 350)", emotion=f"'{e}'"))
                for e in V.INTENSITY_EMOTIONS
            ],
            ("ec", "NULL", template(V.EC_PROMPT, text="left(full_text, 350)")),
        ]
    ),
    "profiles": f"""SELECT article_id,
        max(CASE WHEN task = 'vreg' THEN {_parse_float('raw')} END) AS vreg,
        max(CASE WHEN task = 'voc' THEN {_parse_voc('raw')} END) AS voc,
        {', '.join(f"max(CASE WHEN emotion = '{e}' THEN {_parse_float('raw')} END) AS eireg_{e}"
                   for e in V.INTENSITY_EMOTIONS)},
        max(CASE WHEN task = 'ec' THEN {_parse_ec('raw')} END) AS ec
      FROM task_replies GROUP BY article_id""",
    "long_affect": " UNION ALL ".join(
        f"SELECT article_id, label, '{c}' AS dimension, CAST({c} AS double) AS x FROM affect"
        for c in V.AFFECT_COLUMNS
    ),
    "moments": """SELECT dimension,
        avg(x) FILTER (label = 'real') AS rm, var_samp(x) FILTER (label = 'real') AS rv,
        CAST(count(x) FILTER (label = 'real') AS double) AS rn,
        avg(x) FILTER (label = 'fake') AS fm, var_samp(x) FILTER (label = 'fake') AS fv,
        CAST(count(x) FILTER (label = 'fake') AS double) AS fn
      FROM long_affect GROUP BY dimension""",
    "tvalues": """SELECT *, rn + fn - 2 AS v, (rm - fm) / sqrt(((rn - 1) * rv + (fn - 1) * fv)
        / (rn + fn - 2) * (1 / rn + 1 / fn)) AS t FROM moments""",
    # Two-sided p: one minus twice the density's integral from 0 to |t|, by Simpson's rule.
    "ttests": """SELECT dimension, any_value(rm) AS rm, any_value(rv) AS rv, any_value(fm) AS fm,
        any_value(fv) AS fv, any_value(t) AS t,
        1 - 2 * any_value(exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * abs(t) / 6000)
          * sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                * pow(1 + pow(abs(t) * i / 2000, 2) / v, -(v + 1) / 2)) AS p
      FROM tvalues, range(2001) steps(i) GROUP BY dimension""",
    "dominants": """SELECT article_id, label, CASE
        greatest(eireg_anger, eireg_fear, eireg_joy, eireg_sadness)
        WHEN eireg_anger THEN 'anger' WHEN eireg_fear THEN 'fear'
        WHEN eireg_joy THEN 'joy' WHEN eireg_sadness THEN 'sadness' END AS dominant FROM affect""",
    "buckets": """SELECT article_id, label, CASE WHEN vreg < 0.4 THEN 'negative'
        WHEN vreg < 0.6 THEN 'neutral' ELSE 'positive' END AS bucket FROM affect""",
    "dominant_tab": "SELECT label, "
    + ", ".join(f"count(*) FILTER (dominant = '{e}') AS {e}" for e in V.INTENSITY_EMOTIONS)
    + " FROM dominants WHERE label IS NOT NULL AND dominant IS NOT NULL GROUP BY label",
    "bucket_tab": "SELECT label, "
    + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in V.VREG_BUCKETS)
    + " FROM buckets WHERE label IS NOT NULL GROUP BY label",
    "scaling": "SELECT "
    + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
        for c in V.FEATURES
    )
    + " FROM filled",
    "centroids": "SELECT "
    + ", ".join(
        f"avg({c}) FILTER (y = {y}) AS {n}_{c}" for c in V.FEATURES for y, n in ((1, "f"), (0, "r"))
    )
    + " FROM filled",
    "distances": "SELECT article_id, label, y, "
    + ", ".join(
        "sqrt(" + " + ".join(f"pow(({c} - {n}_{c}) / s_{c}, 2)" for c in V.FEATURES) + f") AS d_{n}"
        for n in "fr"
    )
    + " FROM filled, scaling, centroids",
    "nearest": "SELECT article_id, y, CASE WHEN d_f < d_r THEN 1 ELSE 0 END AS pred FROM distances",
    "class_sizes": """SELECT y, n, CAST(sum(n) OVER (ORDER BY f) - n AS bigint) AS start FROM (
        SELECT y, count(*) AS n, min(article_id) AS f FROM filled GROUP BY y) x""",
    "fold_ends": """SELECT y, fold, sum(size) OVER (PARTITION BY y ORDER BY fold) AS fold_end FROM (
        SELECT y, i AS fold, (SELECT count(*) FROM unnest(range(start, start + n)) p(pos)
          WHERE pos % 5 = i) AS size
        FROM class_sizes, range(5) folds(i)) x""",
    "in_folds": """SELECT r.*, (SELECT count(*) FROM fold_ends e
          WHERE e.y = r.y AND e.fold_end <= r.place) AS fold
      FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY article_id) - 1 AS place
            FROM filled) r""",
    "in_shuffled_folds": """SELECT r.*, (SELECT count(*) FROM fold_ends e
          WHERE e.y = r.y AND e.fold_end <= r.place) AS fold
      FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY
              substr(md5(CAST(article_id AS varchar) || '-42'), 1, 15)) - 1 AS place
            FROM filled) r""",
}


def _cv_views(name: str, scale: str) -> dict[str, str]:
    """Per fold: scaling and centroids of the other folds, predictions, scores."""
    trained = f"""SELECT k.i AS fold, {', '.join(
        f"avg(t.{c}) FILTER (t.y = {y}) AS {n}_{c}" for c in V.FEATURES for y, n in ((1, 'f'), (0, 'r'))
    )}, {', '.join(f"stddev_pop(t.{c}) AS s_{c}" for c in V.FEATURES)}
      FROM range(5) k(i) JOIN in_folds t ON t.fold <> k.i GROUP BY k.i"""

    def distance(n: str) -> str:
        std = (lambda c: f"g.s_{c}") if scale == "global" else (lambda c: f"m.s_{c}")
        return " + ".join(f"pow((a.{c} - m.{n}_{c}) / {std(c)}, 2)" for c in V.FEATURES)

    return {
        f"{name}_models": trained,
        f"{name}_predictions": f"""SELECT a.fold, a.y,
            CASE WHEN sqrt({distance('f')}) < sqrt({distance('r')}) THEN 1 ELSE 0 END AS pred
          FROM in_folds a JOIN {name}_models m USING (fold), scaling g""",
        f"{name}_scores": _scores(f"{name}_predictions", "fold"),
    }


def _scores(source: str, key: str | None) -> str:
    """Weighted scores per key from ``y, pred``."""
    keys = f"{key}, " if key else ""
    group = f" GROUP BY {key}" if key else ""
    return f"""SELECT {keys}(rf1 * (tn + fp) + ff1 * (tp + fn)) / n AS f1_weighted,
        (tp + tn) / n AS accuracy, (rp * (tn + fp) + fp1 * (tp + fn)) / n AS precision_weighted,
        (rr * (tn + fp) + fr * (tp + fn)) / n AS recall_weighted,
        rp, rr, rf1, fp1, fr, ff1, tp, fp, fn, tn, n
      FROM (SELECT *, CASE WHEN rp + rr > 0 THEN 2 * rp * rr / (rp + rr) ELSE 0 END AS rf1,
              CASE WHEN fp1 + fr > 0 THEN 2 * fp1 * fr / (fp1 + fr) ELSE 0 END AS ff1
            FROM (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS rp,
                    coalesce(tn / nullif(tn + fp, 0), 0) AS rr,
                    coalesce(tp / nullif(tp + fp, 0), 0) AS fp1,
                    coalesce(tp / nullif(tp + fn, 0), 0) AS fr
                  FROM (SELECT {keys}CAST(count(*) FILTER (y = 1 AND pred = 1) AS double) AS tp,
                          CAST(count(*) FILTER (y = 0 AND pred = 1) AS double) AS fp,
                          CAST(count(*) FILTER (y = 1 AND pred = 0) AS double) AS fn,
                          CAST(count(*) FILTER (y = 0 AND pred = 0) AS double) AS tn,
                          CAST(count(*) AS double) AS n FROM {source}{group}) a) b) c"""


def _newton_views(steps: int = 8) -> dict[str, str]:
    """Logistic regressions by a fixed number of Newton steps, model -1 on all rows and one per fold.

    A step sums gradient and Gram matrix, eliminates column by column and substitutes back.
    """
    d = len(V.FEATURES)
    weights = range(d + 1)
    upper = [(a, b) for a in weights for b in range(a, d + 1)]
    z = lambda a: f"z{a}" if a < d else "1"
    score = " + ".join(f"w{a} * {z(a)}" for a in weights)
    views = {
        "lr_groups": """SELECT m.i AS model, t.* FROM range(-1, 5) m(i)
          JOIN in_shuffled_folds t ON m.i = -1 OR t.fold <> m.i""",
        "lr_scaling": "SELECT model, "
        + ", ".join(
            f"avg({c}) AS m{a}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s{a}"
            for a, c in enumerate(V.FEATURES)
        )
        + " FROM lr_groups GROUP BY model",
        "lr_rows": "SELECT g.model, g.y, "
        + ", ".join(f"(g.{c} - s.m{a}) / s.s{a} AS z{a}" for a, c in enumerate(V.FEATURES))
        + " FROM lr_groups g JOIN lr_scaling s USING (model)",
        "lr_w0": "SELECT model, "
        + ", ".join(f"CAST(0 AS double) AS w{a}" for a in weights)
        + " FROM lr_scaling",
    }
    for k in range(steps):
        sums = [
            f"sum(p * (1 - p) * {z(a)} * {z(b)}){' + 1' if a == b < d else ''} AS h{a}_{b}" for a, b in upper
        ]
        sums += [f"sum((p - y) * {z(a)}){f' + any_value(w{a})' if a < d else ''} AS g{a}" for a in weights]
        views[f"lr_e{k}_0"] = f"""SELECT model, {', '.join(f'any_value(w{a}) AS w{a}' for a in weights)},
            {', '.join(sums)}
          FROM (SELECT r.*, w.* EXCLUDE (model), 1 / (1 + exp(-({score}))) AS p
                FROM lr_rows r JOIN lr_w{k} w USING (model)) x GROUP BY model"""
        for j in range(d):
            cells = [
                f"h{a}_{b} - h{j}_{a} * h{j}_{b} / h{j}_{j} AS h{a}_{b}" if a > j else f"h{a}_{b}"
                for a, b in upper
            ]
            cells += [
                f"g{a} - h{j}_{a} * g{j} / h{j}_{j} AS g{a}" if a > j else f"g{a}" for a in weights
            ]
            views[f"lr_e{k}_{j + 1}"] = f"""SELECT model, {', '.join(f'w{a}' for a in weights)},
                {', '.join(cells)} FROM lr_e{k}_{j}"""
        source = f"lr_e{k}_{d}"
        for a in reversed(weights):
            rest = "".join(f" - h{a}_{b} * x{b}" for b in range(a + 1, d + 1))
            views[f"lr_x{k}_{a}"] = f"SELECT *, (g{a}{rest}) / h{a}_{a} AS x{a} FROM {source}"
            source = f"lr_x{k}_{a}"
        views[f"lr_w{k + 1}"] = (
            "SELECT model, " + ", ".join(f"w{a} - x{a} AS w{a}" for a in weights) + f" FROM {source}"
        )
    scaled = " + ".join(f"w.w{a} * (t.{c} - s.m{a}) / s.s{a}" for a, c in enumerate(V.FEATURES))
    last = f"lr_w{steps}"
    views["lr_predictions"] = f"""SELECT t.fold, t.y, CASE WHEN {scaled} + w.w{d} > 0 THEN 1 ELSE 0 END AS pred
      FROM in_shuffled_folds t JOIN {last} w ON w.model = t.fold JOIN lr_scaling s ON s.model = t.fold"""
    views["lr_scores"] = _scores("lr_predictions", "fold")
    views["lr_weights"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, w{a} AS weight FROM {last} WHERE model = -1"
        for a, c in enumerate(V.FEATURES)
    )
    views["lr_classified"] = f"""SELECT t.article_id, t.label, 1 / (1 + exp(-({scaled} + w.w{d}))) AS p
      FROM filled t, {last} w, lr_scaling s WHERE w.model = -1 AND s.model = -1"""
    return views


def _means_views(restarts: int = 20, steps: int = 60, seed: int = V.SEED) -> dict[str, str]:
    """Two-means from given starts: each restart moves until its step is at most 1e-4, squared."""
    d = range(len(V.FEATURES))
    z = [f"z{a}" for a in d]
    number = "CAST('0x' || substr(md5(CAST(article_id AS varchar) || '-' || {}), 1, 15) AS bigint)"

    def far(c: int) -> str:
        return " + ".join(f"pow(z{a} - c{c}_{a}, 2)" for a in d)

    views = {
        "km_rows": "SELECT article_id, label, y, "
        + ", ".join(f"({c} - m_{c}) / s_{c} AS z{a}" for a, c in enumerate(V.FEATURES))
        + " FROM filled, scaling",
        "km_first": f"""SELECT r, {', '.join(f'arg_min({x}, h) AS c0_{a}' for a, x in enumerate(z))}
          FROM (SELECT *, {number.format('CAST(r AS varchar)')} AS h
                FROM km_rows, range({seed}, {seed + restarts}) starts(r)) x GROUP BY r""",
        "km_s0": f"""SELECT r, {', '.join(f'any_value(c0_{a}) AS c0_{a}' for a in d)},
            {', '.join(f'arg_min({x}, h) AS c1_{a}' for a, x in enumerate(z))}, false AS done
          FROM (SELECT *, -ln(({number.format("CAST(-r AS varchar)")} + 0.5) / pow(2.0, 60)) / ({far(0)}) AS h
                FROM km_rows, km_first WHERE ({far(0)}) > 0) x GROUP BY r""",
    }
    pairs = [(c, a) for c in (0, 1) for a in d]
    for k in range(steps):
        sums = ", ".join(
            f"coalesce(avg(z{a}) FILTER (cluster = {c}), any_value(c{c}_{a})) AS n{c}_{a}, "
            f"any_value(c{c}_{a}) AS c{c}_{a}"
            for c, a in pairs
        )
        moved = " + ".join(f"pow(n{c}_{a} - c{c}_{a}, 2)" for c, a in pairs)
        new = ", ".join(f"CASE WHEN done THEN c{c}_{a} ELSE n{c}_{a} END AS c{c}_{a}" for c, a in pairs)
        views[f"km_s{k + 1}"] = f"""SELECT r, {new}, done OR {moved} <= 1e-4 AS done
          FROM (SELECT r, any_value(done) AS done, {sums}
                FROM (SELECT *, CASE WHEN {far(1)} < {far(0)} THEN 1 ELSE 0 END AS cluster
                      FROM km_rows, km_s{k}) x GROUP BY r) y"""
    views["km_best"] = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cost, r) AS place
        FROM (SELECT r, round(sum(least({far(0)}, {far(1)})), 6) AS cost, {', '.join(
            f'any_value(c{c}_{a}) AS c{c}_{a}' for c, a in pairs
        )} FROM km_rows, km_s{steps} GROUP BY r) x) y WHERE place = 1"""
    views["km_clusters"] = f"""SELECT article_id, label, y, CASE WHEN c0_0 <= c1_0
          THEN CASE WHEN {far(1)} < {far(0)} THEN 1 ELSE 0 END
          ELSE CASE WHEN {far(0)} < {far(1)} THEN 1 ELSE 0 END END AS cluster FROM km_rows, km_best"""
    return views


def _mixture_views(restarts: int = 10) -> dict[str, str]:
    """Mixtures of two Gaussians from the starts of two-means, by recursion over the steps.

    A covariance is kept as L D L' (unit lower triangle and pivots); a step sums up weights, means and
    products, and eliminates column by column. A restart ends when the mean log-likelihood gains less
    than 1e-4, with the mixture that reached it.
    """
    d = range(len(V.FEATURES))
    upper = [(a, b) for a in d for b in d if a <= b]
    lower = [(b, a) for a, b in upper if a < b]
    fields = ["w", *[f"m{a}" for a in d], *[f"d{a}" for a in d], *[f"l{b}_{a}" for b, a in lower]]
    state = [f"{f}_{c}" for c in (0, 1) for f in fields]

    def score(c: int) -> list[str]:
        rests = [
            f"z{b} - m{b}_{c}" + "".join(f" - l{b}_{a}_{c} * u{a}_{c}" for a in d if a < b) + f" AS u{b}_{c}"
            for b in d
        ]
        far = " + ".join(f"u{a}_{c} * u{a}_{c} / d{a}_{c} + ln(d{a}_{c})" for a in d)
        return [*rests, f"ln(w_{c}) - {len(d)} * ln(2 * pi()) / 2 - ({far}) / 2 AS g_{c}"]

    def sums(c: int) -> list[str]:
        cells = [f"sum(p_{c}) + 1e-14 AS n_{c}"]
        cells += [f"sum(p_{c} * z{a}) AS t{a}_{c}" for a in d]
        return [*cells, *[f"sum(p_{c} * z{a} * z{b}) AS q{a}_{b}_{c}" for a, b in upper]]

    def fitted(c: int) -> list[str]:
        """The new fields, as lateral aliases that end in ``n``."""
        out = [f"n_{c} / n AS w_{c}n", *[f"t{a}_{c} / n_{c} AS m{a}_{c}n" for a in d]]
        for a in d:
            pivot = f"q{a}_{a}_{c} / n_{c} - m{a}_{c}n * m{a}_{c}n + 1e-6"
            out.append(pivot + "".join(f" - l{a}_{k}_{c}n * l{a}_{k}_{c}n * d{k}_{c}n" for k in range(a)) + f" AS d{a}_{c}n")
            for b in d:
                if b > a:
                    rest = f"q{a}_{b}_{c} / n_{c} - m{a}_{c}n * m{b}_{c}n"
                    rest += "".join(f" - l{a}_{k}_{c}n * l{b}_{k}_{c}n * d{k}_{c}n" for k in range(a))
                    out.append(f"({rest}) / d{a}_{c}n AS l{b}_{a}_{c}n")
        return out

    def far(c: int) -> str:
        return " + ".join(f"pow(z{a} - c{c}_{a}, 2)" for a in d)

    both = lambda f: ", ".join([*f(0), *f(1)])
    old = ", ".join(f"any_value({f}) AS {f}" for f in state)
    kept = ", ".join(f"CASE WHEN ended THEN {f} ELSE {f}n END AS {f}" for f in state)
    views = {
        "gm_start": f"""SELECT r, {', '.join(f'{f}n AS {f}' for f in state)}
          FROM (SELECT *, {both(fitted)} FROM (SELECT r, count(*) AS n, {both(sums)}
            FROM (SELECT *, CASE WHEN nearer THEN 0.0 ELSE 1.0 END AS p_0, CASE WHEN nearer THEN 1.0 ELSE 0.0 END AS p_1
              FROM (SELECT *, coalesce({far(1)} < {far(0)}, false) AS nearer
                FROM km_rows, km_s0 WHERE r < {V.SEED + restarts}) x) x GROUP BY r) x) x""",
        "gm_steps": f"""SELECT r, 0 AS step, CAST('-infinity' AS double) AS reached, false AS ended,
            {', '.join(state)} FROM gm_start
          UNION ALL SELECT r, step + 1 AS step, likelihood AS reached, ended, {kept}
          FROM (SELECT *, likelihood - reached < 1e-4 AS ended, {both(fitted)}
            FROM (SELECT r, any_value(step) AS step, any_value(reached) AS reached, count(*) AS n,
                avg(whole) AS likelihood, {old}, {both(sums)}
              FROM (SELECT *, greatest(g_0, g_1) + ln(1 + exp(-abs(g_0 - g_1))) AS whole,
                  exp(g_0 - whole) AS p_0, exp(g_1 - whole) AS p_1
                FROM (SELECT *, {both(score)} FROM km_rows, gm_steps WHERE NOT ended) x) x
              GROUP BY r) x) x""",
        "gm_best": """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(reached, 6) DESC, r) AS place
          FROM gm_steps WHERE ended) x WHERE place = 1""",
        "gm_clusters": f"""SELECT *, CAST(lead > 0 AS int) AS cluster FROM (SELECT article_id, label, y,
            CASE WHEN m0_0 <= m0_1 THEN g_1 - g_0 ELSE g_0 - g_1 END AS lead
          FROM (SELECT *, {both(score)} FROM km_rows, gm_best) x) x""",
    }
    for kind in ("km", "gm"):
        views[f"{kind}_labels"] = f"""SELECT *, CAST(cluster = (SELECT CASE WHEN
          coalesce(avg(y) FILTER (cluster = 0), 0) > coalesce(avg(y) FILTER (cluster = 1), 0)
          THEN 0 ELSE 1 END FROM {kind}_clusters WHERE label IS NOT NULL) AS int) AS pred
          FROM {kind}_clusters"""
    views["method_predictions"] = " UNION ALL ".join(
        f"SELECT '{name}' AS method, CAST(y AS int) AS y, CAST(pred AS int) AS pred FROM {source}"
        for name, source in (
            ("KMeans", "km_labels WHERE label IN ('fake', 'real')"), ("Nearest Centroid", "nearest"),
            ("GMM", "gm_labels WHERE label IN ('fake', 'real')"), ("Affective Distance", "nearest"),
        )
    )
    views["method_scores"] = _scores("method_predictions", "method")
    return views


VIEWS |= _newton_views() | _means_views() | _mixture_views()
VIEWS |= _cv_views("cv", "fold") | _cv_views("gcv", "global")
VIEWS["report"] = _scores("nearest", None)


def _with(body: str) -> str:
    """The body with the views it needs, those first that others use."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            # A recursive view names itself.
            if name not in needed and VIEWS[name] != sql and re.search(rf"\b{name}\b", sql):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n" + body


def _rounded(columns: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


FEATURES6 = _rounded(V.FEATURES, 6)
EIREG = [f"eireg_{e}" for e in V.INTENSITY_EMOTIONS]
HIGH = " UNION ALL ".join(
    f"""SELECT label, '{c}' AS emotion, count(*) FILTER ({c} > 0.5) AS high,
        count(*) FILTER ({c} <= 0.5) AS low,
        round(count(*) FILTER ({c} > 0.5) * 100.0 / count(*), 1) AS high_pct,
        round(100.0 - count(*) FILTER ({c} > 0.5) * 100.0 / count(*), 1) AS low_pct
      FROM affect WHERE label IN ('fake', 'real') GROUP BY label"""
    for c in EIREG
)
SHARE = " UNION ALL ".join(
    f"""SELECT '{c}' AS emotion, round(f, 6) AS fake_pct, round(r, 6) AS real_pct,
        round(f / nullif(r, 0), 6) AS lift FROM (SELECT
        avg(CASE WHEN {c} > 0.5 THEN 100.0 ELSE 0.0 END) FILTER (label = 'fake') AS f,
        avg(CASE WHEN {c} > 0.5 THEN 100.0 ELSE 0.0 END) FILTER (label = 'real') AS r FROM affect) x"""
    for c in EIREG
)


def _percent(table: str, values: list[str]) -> str:
    total = "(" + " + ".join(values) + ")"
    return "SELECT label, " + ", ".join(
        f"round({v} * 100.0 / nullif({total}, 0), 1) AS {v}" for v in values
    ) + f" FROM {table}"


TTEST = """SELECT dimension, round(rm, 6) AS real_mean, round(rv, 6) AS real_var,
    round(fm, 6) AS fake_mean, round(fv, 6) AS fake_var, round(t, 6) AS t, round(p, 8) AS p, {flag}
  FROM ttests{where}"""

VIEWS["spans"] = """SELECT label, dimension,
    CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
    CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM long_affect WHERE dimension <> 'voc' AND x IS NOT NULL GROUP BY label, dimension"""
VIEWS["frame"] = """SELECT label, dimension, CAST(i AS int) AS bin,
    (i - 1) * ((hi - lo) / 20) + lo AS bin_start,
    CASE WHEN i = 20 THEN hi ELSE i * ((hi - lo) / 20) + lo END AS bin_end
  FROM spans, range(1, 21) bins(i)"""
HISTOGRAM = """SELECT f.label, f.dimension, f.bin, round(any_value(bin_start), 6) AS bin_start,
  round(any_value(bin_end), 6) AS bin_end, count(a.x) AS n
FROM frame f LEFT JOIN long_affect a ON a.label = f.label AND a.dimension = f.dimension
  AND a.x >= bin_start AND (a.x < bin_end OR (f.bin = 20 AND a.x <= bin_end))
GROUP BY f.label, f.dimension, f.bin"""

REPORT = """SELECT 'real' AS class, round(rp, 6) AS precision, round(rr, 6) AS recall,
    round(rf1, 6) AS f1, CAST(tn + fp AS bigint) AS support FROM report
  UNION ALL SELECT 'fake', round(fp1, 6), round(fr, 6), round(ff1, 6), CAST(tp + fn AS bigint) FROM report
  UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), CAST(n AS bigint) FROM report
  UNION ALL SELECT 'macro avg', round((rp + fp1) / 2, 6), round((rr + fr) / 2, 6),
    round((rf1 + ff1) / 2, 6), CAST(n AS bigint) FROM report
  UNION ALL SELECT 'weighted avg', round(precision_weighted, 6), round(recall_weighted, 6),
    round(f1_weighted, 6), CAST(n AS bigint) FROM report"""

SCORES = ["f1_weighted", "accuracy", "precision_weighted", "recall_weighted"]


def _na(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({NA}) THEN {c} END AS {c}"


BODIES = {
    "scan_csv": f"""SELECT article_id, {_na('source')}, {_na('lang')}, {_na('title')}, {_na('text')},
        {_na('label')} FROM articles""",
    "scan_csv_strings": """SELECT CAST(article_id AS varchar) AS article_id, source, lang,
        nullif(text, '') AS text FROM articles""",
    "scan_parquet": "SELECT * FROM documents",
    "scan_labelled_files": f"""SELECT CAST(article_id AS varchar) AS id, {_na('title')}, {_na('text')},
        split_part(source, '_', 1) AS source, label FROM articles WHERE label IS NOT NULL""",
    "sink_table": """SELECT article_id, vreg, voc, eireg_anger, eireg_fear, eireg_joy, eireg_sadness, ec
        FROM profiles""",
    "sink_partitioned": "SELECT article_id, full_text, source, label FROM cleaned WHERE label IS NOT NULL",
    "sink_vectors": """SELECT vec_id AS article_id, CAST(len(embedding) AS int) AS dims, round(sqrt(
        list_dot_product(CAST(embedding AS double[]), CAST(embedding AS double[]))), 6) AS norm
        FROM embeddings""",
    "sink_matrix": """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id AS article_id,
        CAST(len(embedding) AS int) AS dims, round(sqrt(list_dot_product(CAST(embedding AS double[]),
        CAST(embedding AS double[]))), 6) AS norm FROM embeddings""",
    "vector_check": """SELECT count(*) AS n_vectors, CAST(min(len(embedding)) AS int) AS min_size,
        CAST(max(len(embedding)) AS int) AS max_size, round(min(n), 4) AS min_norm,
        round(max(n), 4) AS max_norm FROM (SELECT embedding, sqrt(list_dot_product(
        CAST(embedding AS double[]), CAST(embedding AS double[]))) AS n FROM embeddings) x""",
    "resume_todo": """SELECT article_id, source FROM articles
        WHERE article_id NOT IN (SELECT doc_id FROM labels)""",
    "score_batch": """SELECT article_id, task, emotion,
        'Score: 0.' || CAST(length(prompt) % 97 AS varchar) AS raw, 'ok' AS status FROM prompts""",
    "embed_batch": f"""SELECT article_id, CAST(2 AS int) AS dims, CAST({len(V.VREG_PROMPT) - 6} + CASE
        WHEN length(full_text) <= 106 THEN length(full_text)
        WHEN length(left(full_text, 150)) <= 106 THEN length(left(full_text, 150))
        ELSE 80 END AS double) AS first, 'ok' AS status FROM cleaned""",
    "clean_sentinel": "SELECT * FROM no_sentinel",
    "null_profile": """SELECT * FROM (SELECT unnest(['article_id', 'source', 'title', 'label', 'note'])
        AS column_name, unnest([avg(CAST(article_id IS NULL AS int)), avg(CAST(source IS NULL AS int)),
        avg(CAST(title IS NULL AS int)), avg(CAST(label IS NULL AS int)),
        avg(CAST(note IS NULL AS int))]) * 100 AS null_pct FROM no_sentinel) x WHERE null_pct > 70""",
    "drop_sparse_columns": "SELECT article_id, source, title, label FROM no_sentinel",
    "drop_null_rows": """SELECT article_id, source, title, label FROM no_sentinel WHERE article_id
        IS NOT NULL AND source IS NOT NULL AND title IS NOT NULL AND label IS NOT NULL""",
    "drop_columns": "SELECT * FROM articles",
    "full_text": "SELECT article_id, full_text FROM cleaned",
    "filter_short": """SELECT article_id, CAST(length(full_text) AS int) AS chars FROM cleaned
        WHERE length(full_text) > 20""",
    "truncate_text": """SELECT article_id, left(text, 350) AS text_350, left(text, 800) AS text_800,
        left(title, 80) AS title_80 FROM articles""",
    "select_features": f"SELECT article_id, {FEATURES6} FROM affect",
    "label_encode": """SELECT article_id, CAST(CASE WHEN label = 'fake' THEN 1 ELSE 0 END AS int) AS y,
        CASE WHEN label = 'fake' THEN 'fake' ELSE 'real' END AS label_pred FROM articles""",
    "filter_label": "SELECT article_id, source FROM articles WHERE label = 'fake'",
    "fill_features": f"SELECT article_id, {FEATURES6} FROM filled",
    "row_lookup": "SELECT article_id, source, text FROM articles WHERE article_id = 15",
    "table_summary": """SELECT count(*) AS n_rows, 5 AS n_columns,
        'doc_id, text, lang, source, n_chars' AS column_list FROM documents""",
    "table_head": "SELECT * FROM articles ORDER BY article_id LIMIT 5",
    "concat_articles": """SELECT article_id, source, title, label FROM articles
        UNION ALL SELECT page_id, 'web', title, NULL FROM corpus""",
    "row_numbers": """SELECT article_id, source, title, row_number() OVER (ORDER BY part, article_id) - 1 AS row
      FROM (SELECT 0 AS part, article_id, source, title FROM articles
        UNION ALL SELECT 1, page_id, NULL, title FROM corpus) x""",
    "sample_n": """SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY substr(md5(
        CAST(l_orderkey AS varchar) || '-' || CAST(l_linenumber AS varchar) || '-42'), 1, 15),
        CAST(l_orderkey AS varchar) || '-' || CAST(l_linenumber AS varchar) LIMIT 15000""",
    "parse_float": f"SELECT article_id, {_parse_float('raw')} AS score FROM replies",
    "parse_voc": f"SELECT article_id, {_parse_voc('raw')} AS voc FROM replies",
    "parse_ec": f"SELECT article_id, {_parse_ec('raw')} AS ec FROM replies",
    "parse_verdict": "SELECT article_id, verdict, confidence, explanation FROM verdicts",
    "clean_query": "SELECT article_id, query FROM queries",
    "prompt_fanout": "SELECT article_id, task, emotion, prompt FROM prompts",
    "query_prompt": f"""SELECT article_id, {quoted(V.QUERY_INSTRUCTION)} || chr(10) || chr(10)
        || {template(V.QUERY_MESSAGE, text='full_text')} AS prompt FROM cleaned""",
    "scorer_inputs": " UNION ALL ".join(
        f"SELECT article_id, CAST({i} AS int) AS attempt, "
        f"{template(V.VREG_PROMPT, text=f'left(full_text, {n})')} AS prompt FROM cleaned"
        for i, n in enumerate(V.EMBED_RETRY_CHARS)
    ),
    "affect_profile": "SELECT * FROM profiles",
    "attach_profile": f"""SELECT a.article_id, a.source, {FEATURES6}, voc FROM articles a
        LEFT JOIN (SELECT * EXCLUDE (source, label) FROM affect) p ON a.article_id = p.article_id""",
    "dominant_emotion": "SELECT article_id, dominant FROM dominants",
    "vreg_bucket": "SELECT article_id, bucket FROM buckets",
    "label_counts": """SELECT label, count(*) AS n FROM articles WHERE label IS NOT NULL
        GROUP BY label""",
    "source_label_counts": """SELECT source, label, count(*) AS n FROM articles
        WHERE label IS NOT NULL AND source IS NOT NULL GROUP BY source, label""",
    "mean_affect_by_label": "SELECT label, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in V.AFFECT_COLUMNS)
    + " FROM affect WHERE label IS NOT NULL GROUP BY label",
    "mean_affect_by_source_label": "SELECT source, label, "
    + ", ".join(f"round(avg({c}), 3) AS {c}" for c in V.AFFECT_COLUMNS)
    + " FROM affect WHERE label IS NOT NULL AND source IS NOT NULL GROUP BY source, label",
    "ttest_by_label": TTEST.format(flag="coalesce(p < 0.05, false) AS significant", where=""),
    "paper_table": TTEST.format(
        flag="CASE WHEN p < 0.05 THEN '*' ELSE '' END AS significant", where=" WHERE dimension <> 'voc'"
    ),
    "high_emotion_counts": HIGH,
    "high_emotion_share": SHARE,
    "dominant_crosstab": "SELECT * FROM dominant_tab",
    "dominant_pct": _percent("dominant_tab", V.INTENSITY_EMOTIONS),
    "bucket_crosstab": "SELECT * FROM bucket_tab",
    "bucket_pct": _percent("bucket_tab", V.VREG_BUCKETS),
    "affect_histogram": HISTOGRAM,
    "vector_norm": """SELECT vec_id AS article_id, round(sqrt(list_dot_product(
        CAST(embedding AS double[]), CAST(embedding AS double[]))), 6) AS norm FROM embeddings""",
    "cosine_similarity": """SELECT a.vec_id AS article_id, round(list_cosine_similarity(
        CAST(a.embedding AS double[]), CAST(b.embedding AS double[])), 6) + 0.0 AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "mean_pool": """SELECT article_id, CAST(p AS int) AS position,
        round(avg(CAST(embedding[t * part + p + 1] AS double)), 6) + 0.0 AS value
        FROM (SELECT vec_id AS article_id, embedding, len(embedding) // 8 AS part FROM embeddings) e,
          range(8) tokens(t), unnest(range(part)) positions(p) GROUP BY article_id, p""",
    "retrieve_top4": "SELECT article_id, neighbour_id, cosine, rank FROM neighbours",
    "evidence_top_k": "SELECT article_id, page_id, score, rank FROM matches",
    "evidence_text": "SELECT article_id, evidence_text, sources FROM evidence",
    "search_evidence": f"""SELECT page_id AS article_id, title AS answer, url AS sources,
        {template(V.SNIPPET, url='url', title='title', content='left(content, 800)')} AS evidence_text
        FROM corpus""",
    "verdict_prompt": f"""SELECT c.article_id, {quoted(V.VERDICT_INSTRUCTION)} || chr(10) || chr(10) ||
        {template(V.VERDICT_MESSAGE, article='full_text', summary="coalesce(s.title, '')", evidence='evidence_text')}
        AS prompt FROM (SELECT article_id, full_text FROM cleaned) c
        LEFT JOIN evidence e ON c.article_id = e.article_id
        LEFT JOIN corpus s ON s.page_id = c.article_id""",
    "verified_article": """SELECT a.article_id, a.title, q.query, coalesce(e.sources, '') AS sources,
        v.verdict, v.confidence, v.explanation FROM articles a JOIN verdicts v USING (article_id)
        LEFT JOIN evidence e USING (article_id) LEFT JOIN queries q USING (article_id)""",
    "assemble_prompt_inputs": """SELECT c.article_id, c.full_text, c.label, n.neighbours, n.examples,
        round(a.vreg, 6) AS vreg, v.verdict, v.confidence, v.explanation FROM cleaned c
        LEFT JOIN (SELECT n.article_id,
            string_agg(CAST(neighbour_id AS varchar), ',' ORDER BY rank) AS neighbours,
            string_agg(CAST(neighbour_id AS varchar) || ':' || coalesce(o.label, 'none') || ':'
              || coalesce(CAST(CAST(round(s.vreg * 1000) AS int) AS varchar), 'none') || ':'
              || coalesce(left(o.full_text, 40), ''), ' | ' ORDER BY rank) AS examples
          FROM neighbours n LEFT JOIN cleaned o ON o.article_id = n.neighbour_id
          LEFT JOIN affect s ON s.article_id = n.neighbour_id GROUP BY n.article_id) n USING (article_id)
        LEFT JOIN (SELECT article_id, vreg FROM affect) a USING (article_id)
        LEFT JOIN verdicts v USING (article_id)""",
    "standardize": "SELECT article_id, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM affect)) / (SELECT stddev_pop({c}) FROM affect), 6) AS {c}"
        for c in V.FEATURES
    )
    + " FROM affect",
    "class_centroids": "SELECT label, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in V.FEATURES)
    + " FROM filled WHERE label IN ('fake', 'real') GROUP BY label",
    "nearest_centroid": "SELECT article_id, CAST(y AS int) AS y, CAST(pred AS int) AS pred FROM nearest",
    "nearest_centroid_cv": f"SELECT CAST(fold AS int) AS fold, {_rounded(SCORES, 6)} FROM cv_scores",
    "cv_summary": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std "
        "FROM gcv_scores"
        for m in SCORES
    ),
    "affective_distance": """SELECT article_id, label, round(d_r / nullif(d_f + d_r, 0), 4)
        AS affective_score, round(d_f, 4) AS dist_to_fake, round(d_r, 4) AS dist_to_real,
        CASE WHEN d_f < d_r THEN 'fake' ELSE 'real' END AS cluster_pred FROM distances""",
    "stratified_folds": "SELECT article_id, label, CAST(fold AS int) AS fold FROM in_folds",
    "stratified_folds_shuffled": """SELECT article_id, label, CAST(fold AS int) AS fold
        FROM in_shuffled_folds""",
    "classification_report": REPORT,
}
BODIES["stream_scores"] = BODIES["score_batch"]
BODIES["stream_with_retry"] = BODIES["score_batch"]
BODIES["score_with_kept_model"] = BODIES["score_batch"]
BODIES["score_new"] = BODIES["score_batch"]

BODIES |= {
    "logreg_weights": """SELECT feature, round(weight, 6) AS weight,
        CASE WHEN weight > 0 THEN 'FAKE' ELSE 'REAL' END AS direction FROM lr_weights""",
    "classify_affect": """SELECT article_id, label, CASE WHEN p > 0.5 THEN 'fake' ELSE 'real' END AS affect_pred,
        round(greatest(p, 1 - p), 4) AS affect_confidence FROM lr_classified""",
    "logreg_cv": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM lr_scores"
        for m in SCORES
    ),
    "kmeans_labels": "SELECT article_id, label, cluster, pred FROM km_labels",
    "gmm_labels": """SELECT article_id, label, cluster, pred, round(1 / (1 + exp(lead)), 6) AS prob_0,
        round(1 / (1 + exp(-lead)), 6) AS prob_1 FROM gm_labels""",
    "method_summary": f"SELECT method, {_rounded(['f1_weighted', 'accuracy'], 6)} FROM method_scores",
}
BODIES["model_roundtrip"] = BODIES["classify_affect"]

ORACLE = {name: _with(body) for name, body in BODIES.items()}
