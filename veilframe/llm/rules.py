"""Quality rules with cross-document line frequency (built-in functions only).

Lines are normalised (trimmed, lower case, digits as 0, blanks joined), hashed,
and counted by host: in how many different documents of the host does the line
stand?  A document is its id, so copies under several ids count; rows without an id
are told apart by their texts.  Lines in more than ``limit`` documents, and in more
than ``share`` of the host's, are removed; a document that keeps less than
``min_left`` of its words is rejected as depleted, as are those that fail the base
rules.

Shuffles carry line hashes, never texts.  Counts are pre-aggregated in each
task; frequent lines are counted before they are joined back: few are broadcast,
many are dealt over salts, since one line or host may hold a third of all rows.

Defined results: null text: all counts zero, base_failed; null host: one host of
its own (with ''); repeated rows each get their own row; a document without
words is never kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet, table

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def split_words(text: Column) -> Column:
    """Words between blanks; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def base_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("w_", split_words(F.col(text_col)))
    df = df.withColumn("n_words", F.size("w_").cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("l_", lines).withColumn("n_dup_lines", (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"))
    # Windows sorted by hash: equal ones are neighbours.
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w_") - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get("w_", i), F.get("w_", i + 1), F.get("w_", i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("g_", F.when(F.size("w_") >= 3, F.sort_array(grams)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("g_", lambda g, k: (F.get("g_", k - 1)["h"] == g["h"]) | (F.get("g_", k + 1)["h"] == g["h"]))
    df = df.withColumn("r_", F.sort_array(F.transform(twice, lambda g: g["i"])))
    covered = F.aggregate("r_", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("l_", "g_", "r_", "w_")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(line)), "[0-9]", "0"), BLANKS, " ")


def host_lines(text: Column) -> Column:
    """Each different normalised line of a text with a word: (h1, h2, words over all its copies)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normalised), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"), F.size(F.split(F.trim(x), " ")).alias("n")))


def frequent_lines(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", limit: int = 8, share: float = 0.0005) -> DataFrame:
    """(host, h1, h2, n_docs) of the lines in more than ``limit`` different documents, and ``share`` of all, of one host."""
    document = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(3), F.col(id_col).cast("string"))).otherwise(F.xxhash64(F.lit(4), text_col))
    src = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), document.alias("d"), F.explode(host_lines(F.col(text_col))).alias("x"))
    each = src.select("host", "x.h1", "x.h2", "d").distinct()
    sizes = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), document.alias("d")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    counted = each.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > limit)
    return counted.join(sizes, "host").filter(F.col("n_docs") > F.lit(share) * F.col("n_host")).drop("n_host")


def apply_rules(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", limit: int = 8, share: float = 0.0005, min_left: float = 0.5) -> DataFrame:
    """One row per document: ``id_col``, the base counts, base_failed, n_removed_lines, n_removed_words, kept."""
    frequent = table(frequent_lines(docs, text_col=text_col, id_col=id_col, host_col=host_col, limit=limit, share=share).select("host", "h1", "h2", F.lit(True).alias("hit")), "frequent-lines")
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    src = base_counts(src, "text").withColumn("lines", host_lines(F.col("text"))).drop("text")
    lines = src.select("row", "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.posexplode_outer("lines").alias("k", "x"))
    first = F.coalesce(F.col("k"), F.lit(0)) == 0
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    lines = lines.select("row", F.when(first, F.col("id")).alias("id"), "host", "x.h1", "x.h2", "x.n", *[F.when(first, F.col(c)).alias(c) for c in counts])
    joined = meet(lines, frequent, ["host", "h1", "h2"], "row", "left")
    out = joined.groupBy("row").agg(F.max("id").alias(id_col), *[F.max(c).alias(c) for c in counts], F.count_if("hit").alias("n_removed_lines"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("long").alias("n_removed_words"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    left = (F.col("n_words") - F.col("n_removed_words")) >= F.lit(min_left) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left).drop("row")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


#: The same over DuckDB's views.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, host, coalesce(doc_id::VARCHAR, md5(text)) AS doc, regexp_replace(regexp_replace(trim(lower(x), ' '), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS line
      FROM (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
h AS (SELECT host, count(DISTINCT coalesce(doc_id::VARCHAR, md5(text))) AS n_host FROM d GROUP BY host),
f AS (SELECT host, line FROM l JOIN h USING (host) GROUP BY host, line, n_host HAVING count(DISTINCT doc) > greatest(8, 0.0005 * n_host)),
m AS (SELECT rid, count(*) AS n_lines, sum(len(string_split(trim(line, ' '), ' '))) AS n_words FROM l JOIN f USING (host, line) GROUP BY rid),
b AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
      coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n_lines, 0)::BIGINT AS n_removed_lines, coalesce(m.n_words, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN r USING (rid) LEFT JOIN m USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM b
"""
