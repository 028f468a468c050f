"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures that need arrays (words, 8-word windows) are columns of their own, so that higher-order functions look
them up instead of computing them again for each element. Each word is hashed once; a window's hash is made from those
of its halves, in three passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WINDOW = 8
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = "a and das de del der des die du el en et for in is it la las le les los of para que se sich the to un und una une was with zu".split()

#: (measure, lowest, highest) of a document that stays; None is no limit. Measures are columns of ``measured``.
THRESHOLDS = [
    ("n_words", 20, None),
    ("mean_word_chars", 2, 14),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.02, None),
    ("repeated_word_share", None, 0.3),
    ("repeated_line_share", None, 0.4),
    ("upper_share", None, 0.6),
]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts and ratios of the text); null text has no words and zero counts. Ratios of nothing are zero."""
    t = F.col("t")
    bare = F.btrim(t, F.lit(SPACES))
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("t"))
    rows = rows.select(
        id_col, "t",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("words"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):  # each pass hashes neighbours that lie ``k`` words apart: 2, 4, then 8 words
        left = F.size("h") - k
        rows = rows.withColumn("h", F.when(left > 0, F.zip_with(F.slice("h", 1, left), F.slice("h", 1 + k, left), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    twin = lambda j: (F.get("s", j)["x"] == F.get("s", j - 1)["x"]) | (F.get("s", j)["x"] == F.get("s", j + 1)["x"])
    at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.coalesce(twin(j), F.lit(False)))
    rows = rows.withColumn("p", F.when(F.size("s") > 0, F.array_sort(F.transform(at, lambda j: F.get("s", j)["i"]))).otherwise(F.array().cast("array<int>")))
    reach = F.transform("p", lambda x, k: F.least(F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    count = lambda chars: (F.char_length(t) - F.char_length(F.translate(t, chars, ""))).cast("long")
    rows = rows.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(reach, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("abcdefghijklmnopqrstuvwxyz").alias("n_lower"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 1.0, F.col(b)), F.lit(0.0))
    return rows.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"), share("n_stop_words", "n_words").alias("stop_word_share"),
        share("n_repeat_words", "n_words").alias("repeated_word_share"), share("n_dup_lines", "n_lines").alias("repeated_line_share"),
        F.coalesce(F.try_divide(F.col("n_upper") * 1.0, F.col("n_upper") + F.col("n_lower")), F.lit(0.0)).alias("upper_share"),
    )


def verdict(thresholds=THRESHOLDS):
    """One boolean column: every measure within its limits."""
    ok = F.lit(True)
    for name, low, high in thresholds:
        if low is not None:
            ok &= F.col(name) >= low
        if high is not None:
            ok &= F.col(name) <= high
    return ok


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed (under 20 words, or over 30 % of words in repeated windows) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured(docs, id_col, text_col).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(thresholds)).alias("kept"))


def rules_sql(thresholds=THRESHOLDS) -> str:
    """DuckDB SQL of ``quality_rules`` over ``documents``."""
    ws, stops = r"[\x20\x09-\x0D]", ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = " AND ".join([f"{n} >= {a}" for n, a, _ in thresholds if a is not None] + [f"{n} <= {b}" for n, _, b in thresholds if b is not None])
    ratio = lambda a, b: f"coalesce({a} * 1.0::double / nullif({b}, 0), 0)"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    win AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
    k AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS s FROM win),
    twin AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM k) WHERE n > 1),
    cover AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twin) GROUP BY r),
    m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '{ws}', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
        FROM w LEFT JOIN cover USING (r)),
    q AS (SELECT *, {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbols_per_word, {ratio("n_stop_words", "n_words")} AS stop_word_share,
        {ratio("n_repeat_words", "n_words")} AS repeated_word_share, {ratio("n_dup_lines", "n_lines")} AS repeated_line_share, {ratio("n_upper", "n_upper + n_lower")} AS upper_share,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM m)
    SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
        n_repeat_words::bigint AS n_repeat_words, failed AS base_failed, NOT failed AND {tests} AS kept FROM q"""
