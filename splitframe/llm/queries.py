"""Queries opN_<name> of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, html_text, jaccard, language, lines, lm, packing, pieces, quality, runs, suffixes, topk, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_model(spark: SparkSession, sf_dir: str) -> language.TextModel:
    docs = _table(spark, sf_dir, "documents")
    return language.fit_text_model(docs.select(F.col("doc_id").alias("id"), "text", "lang"))


def op3_warc_derivatives(spark, sf_dir):
    made = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "content_length", F.crc32("block").alias("block_crc32"))


def repeated_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where a text whose id has a hash divisible by ten repeats a stretch of its own words up to its end.

    A row without id has no hash and keeps its text.
    """
    doc_id, text, n = F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.col("n")
    hashed = F.crc32(doc_id.cast("string").cast("binary"))
    chosen = docs.select(doc_id.alias("doc_id"), text.alias("text"), (F.pmod(hashed, F.lit(10)) == 0).alias("chosen"), F.floor(hashed / 10).alias("g"))
    words = chosen.withColumn("words", F.when(F.col("chosen"), F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)")))
    sized = words.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("a", F.pmod("g", F.greatest(n, F.lit(1))).cast("int"))
    shaped = sized.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    altered = F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")
    return shaped.select("doc_id", F.when(F.col("chosen") & (n > 0), altered).otherwise(F.col("text")).alias("text"))


def op12_runs_theorem(spark, sf_dir):
    found = runs.periodic_runs(repeated_periods(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def grafted_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of the turns of rebuilt conversations, and all conversations.

    Conversation c starts with the first h turns of conversation c - c % 20, and its own turns from the one after h on follow, where h is the hash of c modulo 4.
    ``%`` takes the sign of c.
    """
    own = trie.positions(turns)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    sizes = own.groupBy("conv_id").agg(F.max("pos").alias("size"))
    convs = sizes.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    bases = sizes.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = common.saved(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0)))), "trie-conversations")
    heads = own.where("conv_id % 20 = 0 and pos <= 3").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos <= h")
    # A row for each block of turns, so that no key has more rows than a block.
    block = F.floor(F.col("pos") / trie.BLOCK)
    blocks = convs.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / trie.BLOCK))).alias("block"))
    tails = own.withColumn("block", block).join(blocks, ["conv_id", "block"]).where("pos > h").withColumn("pos", F.expr("taken + pos - h"))
    columns = ["conv_id", "pos", "role", "text"]
    return heads.select(*columns).unionByName(tails.select(*columns)), convs.select("conv_id")


def op11_heavy_path_trie(spark, sf_dir):
    return trie.prefix_trie(*grafted_turns(_table(spark, sf_dir, "conversations")))


def queries() -> dict:
    documents = lambda spark, d: _table(spark, d, "documents")
    return {
        "op1_cost_balanced_packing": lambda spark, d: packing.pack(documents(spark, d)),
        "op2_vertical_jaccard_join": lambda spark, d: jaccard.near_duplicates(documents(spark, d)),
        "op3_warc_derivatives": op3_warc_derivatives,
        "op4_va_file_top_k": lambda spark, d: topk.top_k(_table(spark, d, "embeddings")),
        "op5_logarithmic_suffix_dedup": lambda spark, d: suffixes.repeat_report(documents(spark, d)),
        "op6_prefix_table_pieces": lambda spark, d: pieces.encode_documents(documents(spark, d)),
        "op7_quality_rules": lambda spark, d: quality.quality_report(documents(spark, d)),
        "op8_scored_html_region": lambda spark, d: html_text.extract(_table(spark, d, "pages")),
        "op9_language_fusion": lambda spark, d: language.identify_pages(_table(spark, d, "pages"), text_model(spark, d)),
        "op10_katz_backoff": lambda spark, d: lm.score(documents(spark, d)),
        "op11_heavy_path_trie": op11_heavy_path_trie,
        "op12_runs_theorem": op12_runs_theorem,
        "op13_sharded_cuckoo_lines": lambda spark, d: lines.dedup_report(documents(spark, d)),
    }


OP4_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""


def _op7_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    ratio = {"n_words": "n_words", "word_chars": "word_chars"}
    tests = []
    for _, dividend, divisor, least, most in quality.RULES:
        value = f"CAST({dividend} AS DOUBLE)" if divisor is None else f"coalesce(CAST({dividend} AS DOUBLE) / nullif({ratio[divisor] if divisor in ratio else divisor}, 0), 0)"
        tests += [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)
), twice AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, CAST(sum(CASE WHEN before IS NULL THEN 8 ELSE least(8, i - before) END) AS BIGINT) AS n_repeat_words FROM twice GROUP BY doc_id
), m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
         CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper
  FROM t LEFT JOIN repeated ON t.doc_id = repeated.doc_id
), j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept, n_lines, n_stop_words, n_upper
FROM j
"""


OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), judged AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_va_file_top_k": OP4_SQL, "op7_quality_rules": _op7_sql(), "op13_sharded_cuckoo_lines": OP13_SQL}
