"""Quality rules with cross-document line frequency. DataFrame functions only.

Words are runs of characters other than space, tab, LF, VT, FF and CR; lines are
the pieces between LF. A line takes part if it holds a word. For comparison over
documents a line is normalised (A-Z lower-cased, white space runs to one space,
trimmed) and hashed to 60 bits.

Per host, a line's frequency is the number of distinct documents that hold it:
documents with the same set of lines (exact copies, whatever the order) count as one,
all others each. A line above its host's limit is removed. A document is
depleted if no more than ``min_words`` words and ``min_share`` of its words are left.

Defined results: null or empty text has no words and fails the base rules; a null
host is a host of its own; repeated rows give repeated result rows; extra columns
are ignored by ``quality_report`` and kept by ``quality_filter``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promospark.llm.common import WORD_SPACE, ascii_lower, cut, text_or_empty

#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 50
    max_repeat_percent: int = 50
    line_docs: int = 20            # a line in no more documents of a host than this stays
    line_docs_per_mille: int = 10  # nor one in no more than this share of the host's documents
    min_share_percent: int = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WORD_SPACE, " " * len(WORD_SPACE)), " ", -1), "")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(normal_line(line)), 1, 15), 16, 10).cast("long")


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Column n_repeat_words from ``words`` and ``n_words``.

    Each three-word window becomes one long: the high bits of its hash, the low
    bits its place. After sorting, windows of equal hash are neighbours; their
    words are compared, so that a hash collision can't count. The places found
    are sorted, and each covers at most three words beyond the last one.
    """
    return (
        df.withColumn("mask", F.expr("-shiftleft(1L, length(bin(n_words)))"))
        .withColumn("sorted_windows", F.expr(
            "CASE WHEN n_words < 4 THEN array() ELSE sort_array(transform(sequence(0, n_words - 3), i -> "
            "(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)) & mask) | i)) END").cast("array<bigint>"))
        .withColumn("equal_at", F.expr(
            "CASE WHEN size(sorted_windows) < 2 THEN array() ELSE "
            "filter(sequence(1, size(sorted_windows) - 1), k -> "
            "(get(sorted_windows, k) & mask) = (get(sorted_windows, k - 1) & mask)) END").cast("array<int>"))
        .withColumn("pairs", F.expr(
            "transform(equal_at, k -> named_struct('a', int(get(sorted_windows, k - 1) & ~mask), "
            "'b', int(get(sorted_windows, k) & ~mask)))"))
        .withColumn("places", F.expr(
            "sort_array(array_distinct(flatten(transform(filter(pairs, p -> "
            "get(words, p.a) = get(words, p.b) AND get(words, p.a + 1) = get(words, p.b + 1) "
            "AND get(words, p.a + 2) = get(words, p.b + 2)), p -> array(p.a, p.b)))))"))
        .withColumn("n_repeat_words", F.expr(
            "aggregate(places, named_struct('last', -3, 'n', 0L), (acc, p) -> "
            "named_struct('last', p, 'n', acc.n + least(3, p - acc.last))).n"))
    )


def base_measures(docs: DataFrame, limits: QualityLimits, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """One slim row per document: id, host, base measures, and its lines as (hash, words)."""
    text = F.col("body")
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                     text_or_empty(text_col).alias("body"))
    df = df.select(
        "doc_id", "host",
        words_of(text).alias("words"),
        F.length(F.translate(text, WORD_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _lines_with_words(text).alias("raw_lines"),
    ).withColumn("n_words", F.size("words"))
    df = _repeat_words(df)
    return df.select(
        "doc_id", "host", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.transform("raw_lines", lambda x: F.struct(
            line_hash(x).alias("hash"), F.size(words_of(x)).alias("words"))).alias("lines"),
    ).withColumn("base_failed", (F.col("n_words") < limits.min_words)
                 | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent))


def frequent_lines(measures: DataFrame, limits: QualityLimits) -> DataFrame:
    """(host, hash) of the lines above their host's limit.

    Sets of lines are made distinct per host before their lines are counted, so that counting needs no
    distinct values: its partial sums leave a row per line and task, however frequent the line is."""
    hashes = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["hash"])))
    sets = (measures.where(F.size("lines") > 0).select("host", hashes.alias("hashes"))
            .select("host", "hashes", F.md5(F.to_json("hashes").cast("binary")).alias("digest")))
    distinct = sets.groupBy("host", "digest").agg(F.first("hashes").alias("hashes"))
    counts = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = measures.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("host", "h_host")
    limit = F.greatest(F.lit(limits.line_docs), F.floor(F.col("host_docs") * limits.line_docs_per_mille / 1000))
    return (counts.where(F.col("n_docs") > limits.line_docs)
            .join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
            .where(F.col("n_docs") > limit).select("host", "hash"))


def _verdicts(measures: DataFrame, limits: QualityLimits) -> DataFrame:
    """``measures`` (with a unique ``row_key``) and what the line rule leaves of each document."""
    frequent = frequent_lines(measures, limits).withColumnsRenamed({"host": "f_host", "hash": "f_hash"})
    hit = (measures.select("row_key", "host", F.explode("lines").alias("line"))
           .select("row_key", "host", "line.hash", "line.words")
           .join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("hash") == F.col("f_hash")))
           .groupBy("row_key").agg(F.sum("words").alias("lost_words"), F.count(F.lit(1)).alias("n_removed_lines"),
                                   F.collect_set("hash").alias("removed_hashes")))
    out = measures.join(hit, "row_key", "left")
    kept = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    depleted = (kept < limits.min_words) & (kept * 100 < F.col("n_words") * limits.min_share_percent)
    return out.select(
        "row_key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        kept.cast("long").alias("kept_words"), "removed_hashes",
        (~F.col("base_failed") & ~depleted).alias("kept"))


def quality_report(docs: DataFrame, limits: QualityLimits = QualityLimits(), id_col: str = "doc_id",
                   text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document with the base measures and the verdict."""
    measures = cut(base_measures(docs, limits, id_col, text_col, host_col)
                   .withColumn("row_key", F.monotonically_increasing_id()))
    return _verdicts(measures, limits).drop("row_key", "removed_hashes")


def quality_filter(docs: DataFrame, limits: QualityLimits = QualityLimits(), text_col: str = "text",
                   host_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The kept documents with their frequent lines removed; columns as given.

    The verdicts join the texts on id, text hash and host, so rows of equal id and
    different text stay apart.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"),
                   F.col(host_col).cast("string").alias("host"))
    slim = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    measures = cut(base_measures(slim, limits).withColumn("row_key", F.monotonically_increasing_id()))
    verdict = (_verdicts(measures, limits).where("kept").select(F.col("doc_id").alias("kept_key"), "removed_hashes")
               .dropDuplicates(["kept_key"]))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    joined = rows.join(verdict, F.col("key.id").eqNullSafe(F.col("kept_key.id"))
                       & (F.col("key.hash") == F.col("kept_key.hash"))
                       & F.col("key.host").eqNullSafe(F.col("kept_key.host")))
    old = F.col("row")[text_col]
    clean = F.when(F.col("removed_hashes").isNull(), old).otherwise(F.array_join(F.filter(
        F.split(old, "\n", -1),
        lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(F.col("removed_hashes"), line_hash(x)))), "\n"))
    out = joined.select("row", clean.alias("clean"))
    fields = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("clean")}
    if length_col and length_col in docs.columns:
        fields[length_col] = F.length("clean").cast(docs.schema[length_col].dataType)
    return out.select(*[c.alias(name) for name, c in fields.items()])
