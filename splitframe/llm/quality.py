"""Operator 7, quality rules: a threshold table compiled into Spark expressions, without user functions.

``measures`` are plain column expressions over the text; ``RULES`` names a ratio of measures with
its allowed range; ``apply_rules`` compiles both into projections over the scan. No row is moved.

Edge cases: null text is the empty text, which has no words, so it fails ``n_words``. A ratio whose
divisor is 0 counts as 0. Repeated rows and rows without id are judged one by one; an empty table gives none. Whole
texts count, however long (the arrays of one row's words and windows are in memory). Extra columns are kept by
``apply_rules``, whatever their names, and dropped by ``quality_report``. Windows are compared by 64-bit hashes within one
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for on with as was at by this from or an are be "
    "der die und das ist in den von zu mit sich auf für nicht ein eine als auch "
    "le la les de des et un une est en que qui dans pour sur pas du au "
    "el los las y en un una es por con para del se no su"
).split()
WINDOW = 8

#: name, dividend, divisor (None: the plain measure), least, most. A text is kept if all hold and base_failed is false.
RULES: tuple[tuple[str, str, str | None, float | None, float | None], ...] = (
    ("words", "n_words", None, 20, None),
    ("mean_word_length", "word_chars", "n_words", 2, 20),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    ("stop_words", "n_stop_words", "n_words", 0.05, None),
    ("upper_case", "n_upper", "word_chars", None, 0.4),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.6),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.3),
)


def _zero_safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures as extra columns, each name after ``prefix``."""
    p = prefix
    spaces = " \t\n\x0b\x0c\r"
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, spaces, "") != "")
    d = docs.withColumns(
        {
            f"{p}_words": words,
            f"{p}_lines": lines,
            f"{p}word_chars": F.length(F.translate(t, spaces, "")).cast("long"),
            f"{p}n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            f"{p}n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
        }
    )
    w, x = F.col(f"{p}_words"), F.col(f"{p}_lines")
    d = d.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}n_lines": F.size(x).cast("long"),
            f"{p}n_dup_lines": (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            f"{p}n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS))))).cast("long"),
            f"{p}_hashes": F.transform(w, lambda x: F.xxhash64(x)),
        }
    )
    h = F.col(f"{p}_hashes")
    windows = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    d = d.withColumn(f"{p}_windows", F.when(F.size(h) >= WINDOW, windows).otherwise(F.expr("cast(array() as array<bigint>)")))
    v = F.col(f"{p}_windows")
    # Only texts that hold a window twice need to know which ones.
    placed = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    d = d.withColumn(f"{p}_placed", F.when(F.size(F.array_distinct(v)) < F.size(v), placed).otherwise(none))
    s = F.col(f"{p}_placed")
    twice = F.filter(
        s,
        lambda e, k: (
            ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == e["h"]))
        ),
    )
    d = d.withColumn(f"{p}_at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    at = F.col(f"{p}_at")
    covered = F.aggregate(
        F.transform(at, lambda i, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), i - F.get(at, k - 1)))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    d = d.withColumn(f"{p}n_repeat_words", covered)
    return d.drop(*[f"{p}{c}" for c in ("_words", "_lines", "_hashes", "_windows", "_placed", "_at")])


def base_failed(prefix: str = "") -> Column:
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * repeat > 30 * n)


def verdict(prefix: str = "", rules=RULES) -> Column:
    """The rules as one boolean expression over the measures."""
    kept = ~base_failed(prefix)
    for _, dividend, divisor, least, most in rules:
        value = F.col(prefix + dividend).cast("double")
        if divisor:
            value = _zero_safe(F.col(prefix + dividend), F.col(prefix + divisor))
        if least is not None:
            kept = kept & (value >= least)
        if most is not None:
            kept = kept & (value <= most)
    return kept


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    p = "quality_" + "_" * max([0, *(len(c) for c in docs.columns)])
    # The row number keeps the filter above the measures; below, it would work them out again for each use.
    measured = with_measures(docs, text, p).withColumn(f"{p}row", F.monotonically_increasing_id())
    return measured.where(verdict(p, rules) & (F.col(f"{p}row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, then the further measures."""
    d = with_measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict(rules=rules).alias("kept"),
        "n_lines", "n_stop_words", "n_upper",
    )
