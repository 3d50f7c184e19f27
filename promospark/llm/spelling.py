"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Two words within one edit have reduced words
within one edit too, so every near pair is found by generating the full one-edit
neighbourhood of each distinct reduced word over the small alphabet, joining it with
the reduced vocabulary, and verifying the original words of the pairs that meet.
The neighbourhoods grow with a word's length and the number of symbols, not with the
number of letters; a pair of words is verified in the join itself, so that only near
pairs leave it.

A word's form is its near word of most occurrences, where it occurs at least
``form_ratio`` times as often as the word; forms are followed to the last by pointer
doubling. Occurrences at least double along a chain, so chains are short and never close.

Before counting, each document's runs of letters may lose a code point by a checksum of
document id and run (``damage``): the misspellings whose repair can be held against the
undamaged text.

Defined results: null or letterless text gives no word; a null id is the empty string in
the checksum; rows of equal id and text count once each; ties in occurrences go to the
word that is lower in code-point order; texts of any length are counted whole, long ones
without gathering their runs; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promospark.llm.common import cut, ship_package, text_or_empty

#: Runs of letters that count as words (fixed value); capitals are lowered from A-Z only.
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
#: Symbols of the reduced alphabet.
SYMBOLS = "01234567"
#: Reduced words are known by polynomials of their symbols modulo 2^64; equal codes of different words
#: only bring more pairs to be verified.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Codes that a task makes at once.
CODES_AT_ONCE = 1 << 21
#: Code points above which a text's runs are met one by one.
LONG_TEXT = 1 << 20
#: Distinct words that a task counts before it hands them on.
COUNTED_AT_ONCE = 300_000


def symbol_of(letter: str) -> str:
    """The letter's symbol, by a multiplicative hash of its code point."""
    return SYMBOLS[(ord(letter) * 2654435761 % (1 << 32) >> 16) % len(SYMBOLS)]


def reduced(word: Column) -> Column:
    return F.translate(word, "".join(LETTERS), "".join(map(symbol_of, LETTERS)))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])


def _values(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomials of every prefix, and of every suffix from its own start, of words of one length."""
    n, length = digits.shape
    heads, tails = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
    np.cumsum(digits * _powers(length)[:length], axis=1, out=heads[:, 1:])
    for i in range(length - 1, -1, -1):
        tails[:, i] = digits[:, i] + BASE * tails[:, i + 1]
    return heads, tails


def neighbour_codes(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each distinct word over the alphabet at most one edit from a row of ``digits``.

    An edit within a run of equal symbols is made at the run's end alone.
    """
    n, length = digits.shape
    heads, tails = _values(digits)
    powers, rows = _powers(length + 1), np.arange(n)
    found_rows, found = [rows], [heads[:, length]]

    def add(mask: np.ndarray, codes: np.ndarray) -> None:
        found_rows.append(rows[mask])
        found.append(codes[mask])

    for i in range(length + 1):
        at_end = np.ones(n, bool)
        if i < length:
            if i + 1 < length:
                at_end = digits[:, i] != digits[:, i + 1]
            add(at_end, heads[:, i] + powers[i] * tails[:, i + 1])
        for symbol in range(1, len(SYMBOLS) + 1):
            put = heads[:, i] + powers[i:i + 1] * np.uint64(symbol)
            differs = digits[:, i] != symbol if i < length else np.ones(n, bool)
            add(differs, put + powers[i + 1] * tails[:, i])
            if i < length:
                add(differs, put + powers[i + 1] * tails[:, i + 1])
    return np.concatenate(found_rows), np.concatenate(found)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, digits from 1) of the reduced words of each length, some at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        places, step = np.flatnonzero(lengths == length), max(1, CODES_AT_ONCE // (16 * length + 16))
        for k in range(0, len(places), step):
            part = places[k:k + step]
            text = "".join(words[i] for i in part.tolist()).encode()
            yield part, (np.frombuffer(text, np.uint8) - np.uint8(ord("0") - 1)).astype(np.uint64).reshape(len(part), length)


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.empty(batch.num_rows, np.uint64)
        for places, digits in _by_length(batch.column("reduced").to_pylist()):
            codes[places] = _values(digits)[0][:, -1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], names=[*batch.schema.names, "code"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column("code").to_numpy(zero_copy_only=False)
        for places, digits in _by_length(batch.column("reduced").to_pylist()):
            rows, codes = neighbour_codes(digits)
            order = np.argsort(rows, kind="stable")  # a word's rows together take less room in the shuffle
            rows, codes = rows[order], codes[order]
            yield pa.RecordBatch.from_arrays([pa.array(own[places][rows]), pa.array(codes.view(np.int64))],
                                             names=["source", "target"])


def _runs(text: str) -> Iterable[str]:
    lowered = text.encode().lower().decode()  # bytes lower A-Z alone
    if len(lowered) < LONG_TEXT:
        return RUNS.findall(lowered)
    return (m.group() for m in RUNS.finditer(lowered))


def damaged(run: str, head: int, damage: int) -> str:
    """``run`` as counted in the document whose id has the checksum ``head``."""
    h = zlib.crc32(run.encode(), head)
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counter(min_length: int, damage: int | None):
    def counted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                head = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(_runs(text)).items():
                    if damage:
                        word = damaged(word, head, damage)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= COUNTED_AT_ONCE:
                    yield counted(counts)
                    counts.clear()
        if counts:
            yield counted(counts)
    return run


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, damage: int | None = 97,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points met at least ``min_count`` times."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"),
                       text_or_empty(text_col).alias("body"))
    return (rows.mapInArrow(_counter(min_length, damage), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def coded(words: DataFrame) -> DataFrame:
    """``words`` (distinct words and n) with each one's reduced word and its code."""
    rows = words.select("word", "n", reduced(F.col("word")).alias("reduced"))
    return rows.mapInArrow(_coder, "word string, n bigint, reduced string, code bigint")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, other, other_n): the ordered pairs of different words one edit apart.

    ``vocab`` is ``coded`` and should be stored, since it is read several times.
    """
    known = vocab.select("reduced", "code").distinct()
    reached = known.mapInArrow(_neighbours, "source bigint, target bigint")
    meeting = reached.join(known.select(F.col("code").alias("target")).distinct(), "target").distinct()
    sources = vocab.select(F.col("code").alias("source"), "word")
    targets = vocab.select(F.col("code").alias("target_"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    one_edit = F.levenshtein("word", "other", 1) == 1  # -1 where more apart
    return (meeting.join(sources, "source").join(targets, (F.col("target") == F.col("target_")) & one_edit)
            .select("word", "other", "other_n"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain that begins at each word of ``forms`` (word, form) ends."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = cut(state.join(ahead, F.col("root") == F.col("at"), "left").select("word", "root", "beyond"))
        if not moved.where("beyond IS NOT NULL").limit(1).count():
            return state
        state = moved.select("word", F.coalesce("beyond", "root").alias("root"))


def variants(words: DataFrame, form_ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (distinct words and n)."""
    ship_package(words.sparkSession)
    words = cut(coded(words))
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    enough = -F.col("best.minus") >= F.col("n") * form_ratio
    found = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    roots = followed(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, damage: int | None = 97,
                      form_ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return variants(vocabulary(docs, min_length, min_count, damage, id_col, text_col), form_ratio)
