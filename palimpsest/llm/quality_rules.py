"""Quality rules: counts of each text, and robust multivariate outliers by language and source, with DataFrame and SQL functions alone.

Base rules fail a text of too few words or of too many in repeated five-word windows. The others are points: transformed
statistics of their texts. In each cell (a language and source of at least ``CELL`` points; else the language's points of such
small sources; else all that is left) the minimum covariance determinant gives a centre and a scatter: from two starts (medians and median deviations; the mean and scatter of all points), ``STEPS``
concentration steps keep the ``HELD`` part of points that is nearest and estimate anew, each lowering the determinant, and the start that ends with the least one is taken. Scatters have a least spread added, so that cells of equal points have one. A text is kept if its Mahalanobis distance, with
the median distance set to what it is for normal points, is within ``CUT``. Where all that is left is less than a cell, it is kept.

Quantiles come from counts of narrow bins, so that a cell is summed before it is shuffled, however large it is; what is joined to the points has a row for each cell.
The steps are one SQL text, which Spark and DuckDB read alike.

A null text has no words, and fails; so does one without words. Null languages and sources are values of their own. Repeated rows are points each. No documents: no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

CELL, HELD, STEPS, CUT = 50, 0.75, 3, 50.0
#: Least spread of each statistic: ln words, ln mean word length, ln symbols, ln repeated lines, ln repeated words.
LEAST = (0.5, 0.1, 0.45, 0.7, 0.8)
D = len(LEAST)
#: Median of a chi-squared variable of D degrees of freedom.
MEDIAN = 4.351460191095529
#: Bins for each unit: of a statistic, and of ln(1 + squared distance).
FINE, FAR = 200, 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
POINT = (
    "ln(CAST(n_words AS DOUBLE))",
    "ln(CAST(word_chars AS DOUBLE) / n_words)",
    "ln(1 + 1000 * CAST(n_symbols AS DOUBLE) / word_chars)",
    "ln(1 + CAST(n_dup_lines AS DOUBLE))",
    "ln(1 + 100 * CAST(n_repeat_words AS DOUBLE) / n_words)",
)


def _repeated(words: Column) -> Column:
    """Words in five-word windows that come twice or more. Only texts with such a window pay for more than a hash set."""
    n = F.size(words)
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, F.lit(5))))).otherwise(F.array().cast("array<long>"))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k + 1 < F.size(s)) & (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        at = F.get(F.transform(F.array(ranked), starts), F.lit(0))
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(i, acc["end"])).alias("n"), (i + 5).alias("end")),
            lambda acc: acc["n"].cast("long"),
        )

    pick = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))
    return F.get(F.transform(F.array(hashes), pick), F.lit(0))


def with_counts(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"_words": F.array_remove(F.split(text, "[ \\t-\\r]+"), ""), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, "[ \\t-\\r]+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeated(F.col("_words")),
        }
    ).drop("_words", "_lines")
    return out.withColumn("base_failed", F.expr(BASE_FAILED))


KEYS = "CASE WHEN lang IS NULL THEN 'n' ELSE concat('s', lang) END AS lk, CASE WHEN source IS NULL THEN 'n' ELSE concat('s', source) END AS sk"


def _with_distance(source: str) -> str:
    """SQL for source with d2, the squared Mahalanobis distance of x1.. from m1.. by the lower Cholesky factor l11.., solved forwards."""
    out = source
    for i in range(1, D + 1):
        left = "".join(f" - l{i}{j} * z{j}" for j in range(1, i))
        out = f"(SELECT *, (x{i} - m{i}{left}) / l{i}{i} AS z{i} FROM {out} AS t{i})"
    return f"(SELECT *, {' + '.join(f'z{i} * z{i}' for i in range(1, D + 1))} AS d2 FROM {out} AS t)"


def _median(source: str, value: str) -> tuple[str, str]:
    """SQL for bins of each statistic of {p}, and for its median bin."""
    each = " UNION ALL ".join(f"SELECT cell, {i} AS j, CAST(floor({value.format(i=i)} * {FINE}) AS BIGINT) AS b FROM {source}" for i in range(1, D + 1))
    return (
        f"SELECT cell, j, b, count(*) AS c FROM ({each}) AS t GROUP BY cell, j, b",
        "SELECT cell, j, min(b) AS b FROM (SELECT cell, j, b, sum(c) OVER (PARTITION BY cell, j ORDER BY b) AS u, sum(c) OVER (PARTITION BY cell, j) AS n FROM {h}) AS t WHERE 2 * u >= n GROUP BY cell, j",
    )


def _cholesky(source: str) -> str:
    """SQL for m1.. and l11.. from a query that gives m1.. and the scatter's s11.. (lower half)."""
    out = f"SELECT * FROM ({source}) AS t"
    for i in range(1, D + 1):
        for j in range(1, i):
            left = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            out = f"SELECT *, (s{i}{j}{left}) / l{j}{j} AS l{i}{j} FROM ({out}) AS t"
        left = "".join(f" - l{i}{k} * l{i}{k}" for k in range(1, i))
        out = f"SELECT *, sqrt(greatest(s{i}{i}{left}, {LEAST[i - 1] ** 2!r} / 4)) AS l{i}{i} FROM ({out}) AS t"
    return out


def steps() -> list[tuple[str, str]]:
    """Names and SQL of the steps from {s}, the counted documents, to {model}: a row for each cell. {name} stands for an earlier step."""
    r, lower = range(1, D + 1), [(i, j) for i in range(1, D + 1) for j in range(1, i + 1)]
    bin_ = f"CAST(floor({FAR} * ln(1 + d2)) AS BIGINT)"
    far = lambda fit: _with_distance(f"(SELECT p.*, st, {', '.join(f'm{i}' for i in r)}, {', '.join(f'l{i}{j}' for i, j in lower)} FROM {{p}} AS p JOIN {{{fit}}} AS f ON p.cell = f.cell)")
    edge = lambda hist, part: f"SELECT cell, st, min(b) AS edge, max(n) AS n FROM (SELECT cell, st, b, sum(c) OVER (PARTITION BY cell, st ORDER BY b) AS u, sum(c) OVER (PARTITION BY cell, st) AS n FROM {{{hist}}}) AS t WHERE u >= {part} * n GROUP BY cell, st"
    out = [
        ("sizes", "SELECT lk, sk, count(*) AS n FROM {s} WHERE NOT base_failed GROUP BY lk, sk"),
        (
            "cells",
            f"SELECT lk, sk, CASE WHEN n >= {CELL} THEN concat('2', lk, '/', sk) WHEN sum(CASE WHEN n < {CELL} THEN n ELSE 0 END) OVER (PARTITION BY lk) >= {CELL} THEN concat('1', lk) ELSE '0' END AS cell FROM {{sizes}}",
        ),
        ("p", "SELECT c.cell, " + ", ".join(f"x{i}" for i in r) + " FROM {s} AS s JOIN {cells} AS c ON s.lk = c.lk AND s.sk = c.sk WHERE NOT base_failed"),
    ]
    h, m = _median("{p}", "x{i}")
    out += [("h1", h), ("medians", m.replace("{h}", "{h1}"))]
    wide = lambda name, col, src: f"SELECT cell, {', '.join(f'max(CASE WHEN j = {i} THEN (b + 0.5) / {FINE} END) AS {col}{i}' for i in r)} FROM {{{src}}} GROUP BY cell"
    out.append(("centre", wide("centre", "m", "medians").replace("0.5", "CAST(0.5 AS DOUBLE)")))
    h, m = _median("{p} JOIN {centre} USING (cell)", "abs(x{i} - m{i})")
    out += [("h2", h), ("deviations", m.replace("{h}", "{h2}")), ("spread", wide("spread", "a", "deviations").replace("0.5", "CAST(0.5 AS DOUBLE)"))]
    first = ", ".join([f"m{i}" for i in r] + [(f"greatest(CAST(1.4826 AS DOUBLE) * a{i}, CAST({LEAST[i - 1]} AS DOUBLE)) AS l{i}{i}" if i == j else f"CAST(0 AS DOUBLE) AS l{i}{j}") for i, j in lower])
    fitted = f"cell, st, {', '.join(f'm{i}' for i in r)}, {', '.join(f'l{i}{j}' for i, j in lower)}"

    def estimate(held: str) -> str:
        """Centre and factor of rows y1.. (from o1..), whose scatter is never less than LEAST."""
        sums = f"SELECT cell, st, count(*) AS n, {', '.join(f'max(o{i}) AS o{i}, sum(y{i}) AS t{i}' for i in r)}, {', '.join(f'sum(y{i} * y{j}) AS q{i}{j}' for i, j in lower)} FROM {held} GROUP BY cell, st"
        scatter = f"SELECT cell, st, {', '.join(f'o{i} + t{i} / n AS m{i}' for i in r)}, " + ", ".join(f"q{i}{j} / n - t{i} / n * t{j} / n" + (f" + CAST({LEAST[i - 1] ** 2!r} AS DOUBLE)" if i == j else "") + f" AS s{i}{j}" for i, j in lower) + f" FROM ({sums}) AS u"
        return f"SELECT {fitted} FROM ({_cholesky(scatter)}) AS v"

    plain = f"(SELECT p.cell, 2 AS st, {', '.join(f'x{i} - m{i} AS y{i}, m{i} AS o{i}' for i in r)} FROM {{p}} AS p JOIN {{centre}} AS c ON p.cell = c.cell) AS t"
    out.append(("fit0", f"SELECT cell, 1 AS st, {first} FROM {{centre}} JOIN {{spread}} USING (cell) UNION ALL {estimate(plain)}"))
    for k in range(STEPS):
        out.append((f"hist{k}", f"SELECT cell, st, b, count(*) AS c FROM (SELECT cell, st, {bin_} AS b FROM {far(f'fit{k}')} AS a) AS t GROUP BY cell, st, b"))
        out.append((f"edge{k}", edge(f"hist{k}", HELD)))
        held = f"(SELECT p.cell, p.st, {', '.join(f'x{i} - m{i} AS y{i}, m{i} AS o{i}' for i in r)} FROM {far(f'fit{k}')} AS p JOIN {{edge{k}}} AS e ON p.cell = e.cell AND p.st = e.st WHERE {bin_} <= edge) AS t"
        out.append((f"fit{k + 1}", estimate(held)))
    # of the starts that a cell has come from, the one whose scatter has the least determinant
    det = " * ".join(f"l{i}{i}" for i in r)
    out.append(("best", f"SELECT {fitted} FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(ln({det}), 9), st) AS place FROM {{fit{STEPS}}}) AS t WHERE place = 1"))
    out.append(("hist_best", f"SELECT cell, st, b, count(*) AS c FROM (SELECT cell, st, {bin_} AS b FROM {far('best')} AS a) AS t GROUP BY cell, st, b"))
    out.append(("edge_best", edge("hist_best", 0.5)))
    last = f"SELECT f.*, e.n, greatest(CAST(1 AS DOUBLE), (exp((edge + 1) / CAST({FAR} AS DOUBLE)) - 1) / CAST({MEDIAN!r} AS DOUBLE)) AS scale FROM {{best}} AS f JOIN {{edge_best}} AS e ON f.cell = e.cell"
    out.append(("model", f"SELECT c.lk, c.sk, m.* FROM {{cells}} AS c JOIN ({last}) AS m ON c.cell = m.cell WHERE m.n >= {CELL}"))
    return out


VERDICT = f"CASE WHEN base_failed THEN FALSE WHEN l11 IS NULL THEN TRUE ELSE d2 <= {CUT!r} * scale END"


def _judge(points: DataFrame, model: DataFrame) -> DataFrame:
    """Adds kept: points beside their cell's model (null where it has none)."""
    out = points.join(model, ["lk", "sk"], "left")
    for i in range(1, D + 1):
        out = out.withColumn(f"z{i}", F.expr(f"(x{i} - m{i}{''.join(f' - l{i}{j} * z{j}' for j in range(1, i))}) / l{i}{i}"))
    return out.withColumn("d2", F.expr(" + ".join(f"z{i} * z{i}" for i in range(1, D + 1)))).withColumn("kept", F.expr(VERDICT))


def _points(counted: DataFrame) -> DataFrame:
    x = {f"x{i}": F.expr(f"CASE WHEN NOT base_failed THEN {e} END") for i, e in enumerate(POINT, 1)}
    return counted.selectExpr("*", *KEYS.replace(" AS lk, ", " AS lk@").split("@")).withColumns(x)


def fit(points: DataFrame) -> DataFrame:
    """A row for each language and source: its cell's centre, factor and scale. points: lk, sk, base_failed, x1.. of a written table."""
    spark, own = points.sparkSession, uuid.uuid4().hex[:8]
    names = {"s": f"s_{own}"}
    points.createOrReplaceTempView(names["s"])
    kept = {}
    for name, sql in steps():
        kept[name] = df = spark.sql(sql.format(**names))
        names[name] = f"{name}_{own}"
        if name not in ("sizes", "h1", "h2") and not name.startswith("hist"):  # each of these is read once, by the next
            df = kept[name] = C.staged(df, name)
        df.createOrReplaceTempView(names[name])
    for v in names.values():
        spark.catalog.dropTempView(v)
    return kept["model"]


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def _judged(docs: DataFrame, *more: str) -> DataFrame:
    """_row (a document as it came), base_failed, kept and more columns. The documents and their points are written once, so that no text is counted twice or shuffled."""
    own = docs.select(F.struct(*[_named(c) for c in docs.columns]).alias("_row"), *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source", "text")])
    points = C.staged(_points(with_counts(own)).drop("text", "lang", "source"), "points")
    return _judge(points, fit(points.drop("_row")).drop("cell", "st", "n")).select("_row", "base_failed", "kept", *more)


def judged(docs: DataFrame) -> DataFrame:
    """The documents' columns but for the text, with the counts, base_failed and kept, whose names are taken."""
    held = [c for c in docs.columns if c not in ("text", *COUNTS, "base_failed", "kept")]
    return _judged(docs.select("text", *map(_named, held)), *COUNTS).select(*[F.col(f"_row.`{c}`").alias(c) for c in held], *COUNTS, "base_failed", "kept")


def pass_rules(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they were."""
    return _judged(docs).where("kept").select("_row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql() -> str:
    base = r"""
d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), counted AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
), judged AS (
  SELECT *, """
    x = ", ".join(f"CASE WHEN NOT base_failed THEN {e} END AS x{i}" for i, e in enumerate(POINT, 1))
    out = f"WITH {base.strip()} {BASE_FAILED} AS base_failed FROM counted\n), s AS MATERIALIZED (\n  SELECT *, {KEYS}, {x} FROM judged\n)"
    named = {name: name for name, _ in steps()} | {"s": "s"}
    for name, sql in steps():
        out += f", {name} AS MATERIALIZED (\n  {sql.format(**named)}\n)"
    far = _with_distance("(SELECT * FROM s LEFT JOIN model USING (lk, sk))")
    return out + f"\nSELECT doc_id, {', '.join(COUNTS)}, base_failed, {VERDICT} AS kept FROM {far} AS f"


OP2_SQL = _sql()
