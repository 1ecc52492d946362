"""Operator 9, language identification by Bayesian evidence fusion.

For each row, log P(language | evidence) adds up, before normalising:

* text: tempered log-likelihood of hashed byte trigrams, from a model fitted on labelled documents;
* declared: the language that markup or metadata declares, right with probability ``DECLARED_RIGHT``;
* suffix: the last label of the address, if it is the code of a language;
* host: a prior smoothed from all rows to the address suffix, the domain and the host in turn. Its
  counts are sums of the posteriors without it, from grouped aggregation over all rows, less the row's own, which has
  its say already (``identify_pages``), or with it (``accepted_documents``, for the memory that its stage has).

The text model is fitted on about ``FIT_ROWS`` labelled documents (chosen by a hash of the id); all
other counts cover all rows.

Beside the fitted languages stands the class of all other texts: its trigrams come half from an even
draw of all hashes, half from an even draw of a-z and space, its share is ``OTHER_SHARE``, and a fitted
language in its markup or suffix counts as wrong. So trigrams that no fitted language has speak for it,
not for the language with the fewest. A row is rejected if its text has no trigram with a letter, or if
the posterior of its best language is below ``LEAST_POSTERIOR``.

Edge cases: null and empty texts, and texts of the other class, have language ``und`` and are
rejected; null declarations and hosts add no evidence; unknown languages in a declaration add none
either. Of languages with equal posteriors the first in the alphabet is chosen. Repeated rows count as often as they
occur; a null id stays null. Whole texts count, however long. An empty table gives an empty table; without labelled rows all is
``und`` and rejected. Columns of the input keep their values; clashing names are avoided by a prefix.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, saved

FIT_ROWS = 4000
BUCKETS = 1 << 16
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
#: A text counts as this many independent trigrams at most.
TEMPER = 60.0
SMOOTHING = 20.0
LEAST_POSTERIOR = 0.5
#: Prior share of texts in none of the fitted languages.
OTHER_SHARE = 0.01
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) >> np.uint32(16)


def _other() -> np.ndarray:
    """Log-likelihoods of trigrams in a text of no fitted language."""
    plain = np.array([0x20, *range(97, 123)], np.uint32)
    found = np.bincount(_hash(plain[:, None, None], plain[:, None], plain).ravel(), minlength=BUCKETS)
    return np.log(0.5 / BUCKETS + 0.5 * found / found.sum()).astype(np.float32)


_OTHER = _other()


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts in a row, whether each counts, and each text's first place.

    Case of A-Z and kinds of white space don't matter. A trigram counts if it lies in one text and
    all its bytes are letters or spaces, not all of them spaces.
    """
    data, bounds = joined(texts)
    raw = np.frombuffer(data + b"\n\n", np.uint8)
    n = len(data)
    b = _FOLD[raw]
    hashed = _hash(b[:n], b[1 : n + 1], b[2 : n + 2])
    letter, fits = _LETTER[raw], _LETTER[raw] | (b == 0x20)
    counts = fits[:n] & fits[1 : n + 1] & fits[2 : n + 2] & (letter[:n] | letter[1 : n + 1] | letter[2 : n + 2])
    for back in (1, 2):  # the last places of a text reach into the next
        counts[np.maximum(bounds[1:] - back, 0)] = False
    ends = bounds[1:] - 3
    counts[ends[ends >= 0]] &= False
    return hashed, counts, bounds


class TextModel:
    """Log-likelihoods of trigrams by language; ``table`` is of shape (languages, BUCKETS)."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def score(self, texts: list) -> list[list[float]]:
        """Per text its summed log-likelihoods, the last of the other class, then its number of trigrams."""
        hashed, counts, bounds = trigrams(texts)
        at = bounds[:-1]
        if not len(at):
            return []
        sums = [np.add.reduceat(np.where(counts, row[hashed], np.float32(0)).astype(np.float64), at) for row in (*self.table, _OTHER)]
        return np.stack([*sums, np.add.reduceat(counts.astype(np.float64), at)], axis=1).tolist()


def fit_text_model(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> TextModel:
    """From columns id, text, lang: trigram counts of about ``fit_rows`` rows with a language."""
    import pyarrow as pa

    known = labelled.where(F.col("lang").isNotNull() & (F.length(F.trim("lang")) > 0))
    share = min(1.0, fit_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < round(share * 1_000_000))

    def counted(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                hashed, counts, _ = trigrams([t for t, s in zip(texts, langs) if s == lang])
                found = np.bincount(hashed[counts], minlength=BUCKETS)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["lang", "bucket", "n"])

    rows = (
        sample.select(F.col("text").cast("string"), F.lower(F.trim("lang")).alias("lang"))
        .mapInArrow(counted, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
        .orderBy("lang").collect()
    )
    table = np.full((len(rows), BUCKETS), 0.5, np.float64)
    for k, r in enumerate(rows):
        table[k, np.array(r.bucket, int)] += np.array(r.n, float)
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if len(rows) else table.astype(np.float32)
    return TextModel([r.lang for r in rows], table)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def markup_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))


def visible_text(html: Column) -> Column:
    """Markup, scripts and styles blanked out; character references stay, they decide nothing."""
    silent = r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;"
    return F.regexp_replace(F.coalesce(html, F.lit("")), silent, " ")


def _log_sum(values: list[Column]) -> Column:
    top = F.greatest(*values) if len(values) > 1 else values[0]
    return top + F.log(sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top)))


def _told(code: Column, language: str | None, languages: list[str], right: float) -> Column:
    """Log-likelihood of a declaration under a language (None: another one); the same for all where it names none of them."""
    wrong = math.log((1 - right) / max(1, len(languages) - 1))
    return F.when(code == F.lit(language), math.log(right)).when(code.isin(languages), wrong).otherwise(0.0)


def identify(df: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, into: str = "_language", done_with: list[str] | None = None, leave_out: bool = True) -> DataFrame:
    """``df`` with struct column ``into`` (language, posterior, accepted); its other columns stay as they are.

    The scores are read twice, for the host priors and for the verdict. Given the columns that nothing needs
    afterwards (``done_with``), scores and the other columns are written in between instead of worked out again.
    With ``leave_out`` a row's own posterior is taken out of its host's prior, in a batch function; without it all of a host's rows have one prior.
    """
    langs = model.languages
    p = "_" * max([1, *(len(c) for c in df.columns)])  # no column has such a name with more after it
    if not langs:
        return df.withColumn(into, F.expr("named_struct('language', 'und', 'posterior', 0.0D, 'accepted', false)"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(texts: pd.Series) -> pd.Series:
        out = []
        for low in range(0, len(texts), 256):
            out += model.score(texts.iloc[low : low + 256].tolist())
        return pd.Series(out, dtype=object)

    scored = scored.asNondeterministic()  # it gives the same each time, but is not to be inlined and run again
    each = range(len(langs))
    d = df.withColumns(
        {
            f"{p}score": scored(text),
            f"{p}code": F.lower(F.substring(F.coalesce(declared, F.lit("")), 1, 2)),
            f"{p}host": F.coalesce(host, F.lit("")),
        }
    )
    d = d.withColumn(f"{p}n", F.get(f"{p}score", len(langs) + 1))
    weight = F.when(F.col(f"{p}n") > TEMPER, F.try_divide(F.lit(TEMPER), F.col(f"{p}n"))).otherwise(1.0)
    suffix = F.substring_index(f"{p}host", ".", -1)
    d = d.withColumns(
        {
            f"{p}own{k}": F.get(f"{p}score", k) * weight + _told(F.col(f"{p}code"), x, langs, DECLARED_RIGHT) + _told(suffix, x, langs, SUFFIX_RIGHT)
            for k, x in enumerate([*langs, None])
        }
    )
    # Relative to a prior of 1 over all fitted languages, as the host's is.
    other = F.col(f"{p}own{len(langs)}") + math.log(OTHER_SHARE / (1 - OTHER_SHARE))
    own = [F.col(f"{p}own{k}") for k in each]
    if done_with is not None:
        d = saved(d.drop(*done_with), "language-scores")
    soft = d.select(f"{p}host", *own, (other + math.log(len(langs))).alias(f"{p}other")).withColumn(f"{p}whole", _log_sum([*own, F.col(f"{p}other")]))
    sums = soft.groupBy(f"{p}host").agg(*[F.sum(F.exp(own[k] - F.col(f"{p}whole"))).alias(f"s{k}") for k in each])
    sums = saved(sums.withColumnRenamed(f"{p}host", "_host"), "host-counts")
    if leave_out:
        levels = host_sums(sums, langs).withColumnsRenamed({"_host": f"{p}host", "_levels": f"{p}levels"})
        rest = left_out_priors(len(langs))(F.flatten(f"{p}levels"), F.array(*own, other + math.log(len(langs))))
        out = d.join(levels, f"{p}host").withColumn(f"{p}prior", rest).drop(f"{p}levels")  # each host has its sums
    else:
        out = d.join(host_priors(sums, langs).withColumnsRenamed({"_host": f"{p}host", "_prior": f"{p}prior"}), f"{p}host", "left")
    out = out.withColumns({f"{p}all{k}": own[k] + F.coalesce(F.get(f"{p}prior", k), F.lit(-math.log(len(langs)))) for k in each})
    total = [F.col(f"{p}all{k}") for k in each]
    out = out.withColumns({f"{p}best": F.greatest(*total) if len(total) > 1 else total[0], f"{p}whole": _log_sum([*total, other])})
    chosen = F.coalesce(*[F.when(total[k] == F.col(f"{p}best"), x) for k, x in enumerate(langs)])
    known, posterior = F.col(f"{p}n") > 0, F.exp(F.col(f"{p}best") - F.col(f"{p}whole"))
    verdict = F.struct(
        F.when(known & (F.col(f"{p}best") >= other), chosen).otherwise("und").alias("language"),
        F.when(known, posterior).otherwise(0.0).alias("posterior"),
        (known & (posterior >= LEAST_POSTERIOR)).alias("accepted"),
    )
    extra = [f"{p}host", f"{p}score", f"{p}code", f"{p}n", f"{p}prior", f"{p}best", f"{p}whole", *[f"{p}own{k}" for k in range(len(langs) + 1)], *[f"{p}all{k}" for k in each]]
    return out.withColumn(into, verdict).drop(*extra)


def host_priors(sums: DataFrame, langs: list[str]) -> DataFrame:
    """Log priors by host: each level's counts are smoothed by the level above it."""
    k = range(len(langs))
    name = F.col("_host")
    parts = F.split(name, r"\.")
    d = sums.withColumns({"_suffix": F.element_at(parts, -1), "_domain": F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))})

    def level(by: list[str], tag: str) -> DataFrame:
        return d.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"{tag}{i}") for i in k])

    everything = d.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"g{i}") for i in k]).first()
    total = sum(everything) or 1.0
    top = [(x + 1.0) / (total + len(langs)) for x in everything]
    d = d.join(level(["_suffix"], "x"), "_suffix").join(level(["_suffix", "_domain"], "m"), ["_suffix", "_domain"])

    def smoothed(tag: str, above: list[Column]) -> list[Column]:
        whole = sum((F.col(f"{tag}{i}") for i in k), F.lit(0.0))
        return [(F.col(f"{tag}{i}") + SMOOTHING * above[i]) / (whole + SMOOTHING) for i in k]

    p = [F.lit(x) for x in top]
    for tag in ("x", "m", "s"):
        d = d.withColumns({f"p_{tag}{i}": c for i, c in enumerate(smoothed(tag, p))})
        p = [F.col(f"p_{tag}{i}") for i in k]
    return d.select("_host", F.array(*[F.log(c) for c in p]).alias("_prior"))


def host_sums(sums: DataFrame, langs: list[str]) -> DataFrame:
    """_host and ``_levels``: the sums by language of all rows, of the host's suffix, of its domain and of itself, from the sums s0, s1, ... by host."""
    k = range(len(langs))
    name = F.col("_host")
    parts = F.split(name, r"\.")
    d = sums.withColumns({"_suffix": F.element_at(parts, -1), "_domain": F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))})

    def level(by: list[str], tag: str) -> DataFrame:
        return d.groupBy(*by).agg(F.array(*[F.sum(f"s{i}") for i in k]).alias(tag))

    everything = d.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"g{i}") for i in k]).first()
    met = d.join(level(["_suffix"], "x"), "_suffix").join(level(["_suffix", "_domain"], "m"), ["_suffix", "_domain"])
    return met.select("_host", F.array(F.array(*[F.lit(float(g)) for g in everything]), F.col("x"), F.col("m"), F.array(*[F.col(f"s{i}") for i in k])).alias("_levels"))


def left_out_priors(n: int):
    """A function of a host's levels and a row's own scores (and the one of other texts): the log prior of each of ``n`` languages from all rows but this one.

    Each level's sums, less the row's own part, are smoothed by the level above it.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def priors(levels: pd.Series, own: pd.Series) -> pd.Series:
        if not len(levels):
            return pd.Series([], dtype=object)
        sums = np.stack(levels.to_numpy()).reshape(len(levels), -1, n)
        scores = np.stack(own.to_numpy())
        parts = np.exp(scores - scores.max(axis=1, keepdims=True))
        mine = (parts / parts.sum(axis=1, keepdims=True))[:, :n]
        p = np.full_like(mine, 1 / n)
        for level in range(sums.shape[1]):
            held, smoothing = np.maximum(sums[:, level] - mine, 0.0), SMOOTHING if level else n
            p = (held + smoothing * p) / (held.sum(axis=1, keepdims=True) + smoothing)
        return pd.Series(list(np.log(p)), dtype=object)

    return priors.asNondeterministic()  # it gives the same each time, but a filter on the verdict is not to run it again


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, language, posterior and accepted for every page."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    d = d.select("page_id", visible_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("lang"), host_of(F.col("url")).alias("host"))
    out = identify(d, model, F.col("text"), F.col("lang"), F.col("host"), done_with=["text", "lang", "host"])
    return out.select("page_id", "_language.language", F.round("_language.posterior", 6).alias("posterior"), "_language.accepted")


def accepted_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """Rows of ``docs`` whose language is certain enough; ``lang`` is the declaration, ``source`` the host."""
    found = "_language" + "_" * max([0, *(len(c) for c in docs.columns)])
    out = identify(docs, model, F.col("text"), F.col("lang"), F.col("source"), found, leave_out=False)
    return out.where(F.col(found)["accepted"]).select(*[F.col(f"`{c}`") for c in docs.columns])
