"""Quality rules: a threshold table compiled into one projection of built-in expressions.

``measured`` adds a struct of whole-text measures, ``judged`` adds the rules a
row fails.  Everything is row-local (no shuffle).  A null text has no words;
a text without words has every ratio 0 and fails the length rule; repeated
rows are judged alike; an empty table gives an empty result.  Texts are
measured whole, however long (no rule has an upper length).  The input's own
columns are kept aside while measuring, so no name of theirs can clash; a
column named like the output struct is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = ("the of and to in that is for on with as was be by "
              "le la les de des et un une en du que qui dans pour "
              "der die das und ist ein eine zu den von mit im nicht "
              "el los las y una por con se del al").split()

# rule -> (measure, divided by, smallest, largest); None leaves a side open.
RULES: dict[str, tuple[str, str | None, float | None, float | None]] = {
    "length": ("n_words", None, 20, None),
    "word_length": ("word_chars", "n_words", 2.0, 20.0),
    "symbols": ("n_symbols", "n_words", None, 0.3),
    "stop_words": ("n_stop_words", "n_words", 0.02, None),
    "repeated_words": ("n_repeat_words", "n_words", None, 0.3),
    "repeated_lines": ("n_dup_lines", "n_lines", None, 0.5),
    "ellipsis_lines": ("n_ellipsis_lines", "n_lines", None, 0.5),
    "bullet_lines": ("n_bullet_lines", "n_lines", None, 0.9),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines",
            "n_ellipsis_lines", "n_bullet_lines")


def _count(array: Column) -> Column:
    return F.size(array).cast("bigint")


def measured(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add struct ``out`` of :data:`MEASURES` (all bigint).

    ``n_repeat_words`` counts the words inside windows of :data:`WINDOW` words
    found twice or more in the text, the first included.  Each layer below is
    a projection of its own because the next one uses its arrays more than
    once; sorting happens only in texts that hold a repeated window.
    """
    layer = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]).alias("row"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    layer = layer.select(
        "row",
        F.length(F.regexp_replace("text", WHITE_RUN, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split(F.btrim("text", F.lit(WHITE)), WHITE_RUN), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"))
    layer = layer.select(
        "row", "word_chars", "n_symbols",
        _count(F.col("words")).alias("n_words"),
        _count(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        _count(F.col("lines")).alias("n_lines"),
        (_count(F.col("lines")) - _count(F.array_distinct("lines"))).alias("n_dup_lines"),
        _count(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))
        .alias("n_ellipsis_lines"),
        _count(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"))
    kept = ["row", *[m for m in MEASURES if m != "n_repeat_words"]]
    layer = layer.select(
        *kept, F.when(F.size("hashes") >= WINDOW,
                      F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)),
                                  lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    layer = layer.select(
        *kept, F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
                      F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted"))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    layer = layer.select(
        *kept, F.array_sort(F.transform(
            F.filter("sorted", lambda x, i: same(x, F.get("sorted", i - 1)) | same(x, F.get("sorted", i + 1))),
            lambda x: x["i"])).alias("starts"))
    covered = F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - x, F.lit(WINDOW))))
    layer = layer.select(*kept, F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_repeat_words"))
    return layer.select("row.*", F.struct(*MEASURES).alias(out))


def failed_rules(measures: str = "quality", rules: dict = RULES) -> Column:
    """The names of the rules that a row of :func:`measured` fails, as one array expression."""
    of = lambda name: F.col(f"`{measures}`.{name}").cast("double")
    names = []
    for rule, (value, per, low, high) in rules.items():
        x = of(value)
        if per is not None:
            x = F.when(of(per) > 0, of(value) / of(per)).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (x < F.lit(float(low)))
        if high is not None:
            bad = bad | (x > F.lit(float(high)))
        names.append(F.when(bad, F.lit(rule)))
    return F.array_compact(F.array(*names))


def base_failed(measures: str = "quality") -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows (in exact integers)."""
    of = lambda name: F.col(f"`{measures}`.{name}")
    return (of("n_words") < 20) | (of("n_repeat_words") * 100 > of("n_words") * 30)


def judged(df: DataFrame, text: str = "text", out: str = "quality", rules: dict = RULES) -> DataFrame:
    """Add ``out`` (measures, ``failed`` rule names, ``base_failed``, ``kept``) to every row."""
    m = measured(df, text, out)
    fields = [F.col(f"`{out}`.{c}").alias(c) for c in MEASURES]
    failed, base = failed_rules(out, rules), base_failed(out)
    return m.withColumn(out, F.struct(*fields, failed.alias("failed"), base.alias("base_failed"),
                                      (~base & (F.size(failed) == 0)).alias("kept")))


def accepted(df: DataFrame, text: str = "text", rules: dict = RULES) -> DataFrame:
    """The rows that pass, with their own columns.

    The row number keeps the optimizer from pushing the filter below the
    measuring projections, which would write every array expression out again
    at each of its uses.
    """
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.col(f"`{text}`").alias("text"))
    rows = judged(kept, "text", "verdict", rules).withColumn("number", F.monotonically_increasing_id())
    return rows.where(F.col("verdict.kept") & (F.col("number") >= 0)).select("own.*")


def oracle_sql(rules: dict = RULES) -> str:
    """The query's rows in DuckDB."""
    terms = []
    for value, per, low, high in rules.values():
        x = f"{value}::double" if per is None else f"(case when {per} > 0 then {value}::double / {per}::double else 0.0 end)"
        terms += [f"{x} {sign} {float(v)!r}" for sign, v in (("<", low), (">", high)) if v is not None]
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: trim(x, {blank}) <> '') AS lines FROM t),
win AS (SELECT rid, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
m AS (SELECT rid, doc_id, len(words)::bigint AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
             len(list_filter(words, lambda x: lower(x) IN ({stops})))::bigint AS n_stop_words,
             len(lines)::bigint AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
             len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::bigint AS n_ellipsis_lines,
             len(list_filter(lines, lambda x: substring(ltrim(x, ' '), 1, 1) IN ('-', '*', '•')))::bigint AS n_bullet_lines FROM w),
a AS (SELECT m.*, coalesce(cov.n_repeat_words, 0)::bigint AS n_repeat_words FROM m LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {' OR '.join(terms)}) AS kept FROM b"""
