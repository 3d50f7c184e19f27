"""Removal of byte strings that start in an earlier document, by merging sorted shards of suffixes.

A string of ``length`` bytes is judged by the suffix that starts with it. Suffixes are
sorted in shards, and the shards are merged by interleave refinement: all suffixes
begin in one class; each round reads one symbol (eight bytes) of every suffix whose class
still has others and splits the classes by it, keeping the shards' order within a
class. The round in which neighbours part gives their common prefix; classes left after
``length`` bytes are the repeated intervals, whose least document decides.

Only suffixes that can repeat take part, and each shard's share of them is routed to
others that may equal them. Every ``length`` bytes hold a minimizer, the least hash among
its grams; equal strings hold equal ones. Runs of suffixes with one minimizer travel as one
context to the part that its hash names, and only if a second document has the same
minimizer. Whole copies of earlier documents are found by digest and need no merging.

Documents are told apart by id and order by it, null first; rows of equal id don't remove
from each other. Null text counts as empty. Matches never cross documents. Repeated rows
give repeated result rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promospark.llm.common import cut, ship_package, text_or_empty
from promospark.llm.shingles import mixed

#: Bytes of contexts merged together, up to a minimizer's last context.
MERGED_AT_ONCE = 4 << 20
#: Bytes of text for each part that contexts are dealt into by their minimizers.
TEXT_PER_PART = 1 << 15
SHARDS = 4
LEAST_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
LONG = pa.int64()


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def gram_width(length: int) -> int:
    return max(1, length * 2 // 5)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` bytes, by doubling and adding."""
    with np.errstate(over="ignore"):
        power, size = data.astype(np.uint64) + np.uint64(1), 1  # hashes of runs of ``size``
        out, have, rest = None, 0, width
        while rest:
            if rest & 1:
                n = len(data) - have - size + 1
                shift = np.uint64(pow(BASE, size, 1 << 64))
                out = power if out is None else out[:n] * shift + power[have:have + n]
                have += size
            rest >>= 1
            if rest:
                power = power[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:]
                size *= 2
    return mixed(out)


def minimizers(data: np.ndarray, length: int) -> np.ndarray:
    """For each start of ``length`` bytes, the least hash among their grams."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    width = gram_width(length)
    return _sliding(gram_hashes(data, width), length - width + 1, np.minimum)


def shown(hashes: np.ndarray) -> np.ndarray:
    """The high 48 bits, which travel; equal ones of different grams only cost a comparison."""
    return (hashes >> np.uint64(16)).astype(np.int64)


def runs_of(values: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values, cut at ``longest``."""
    n = len(values)
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    sizes = np.diff(np.append(edges, n))
    if sizes.max() > longest:
        edges = np.concatenate([np.arange(a, a + s, longest) for a, s in zip(edges, sizes)])
    return edges, np.append(edges[1:], n)


def _bytes_of(value) -> np.ndarray:
    return np.frombuffer(value, np.uint8)


def _minimizer_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for order, body in zip(batch.column("ord").to_pylist(), batch.column("body").to_pylist()):
                own = minimizers(_bytes_of(body), length)
                if len(own):
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    own = np.unique(shown(own))
                    hashes.append(own)
                    ids.append(np.full(len(own), order, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ids))],
                                                 names=["hash", "ord"])
    return run


def _context_rows(length: int, parts: int):
    """Rows (part, ord, context): a run's start in four bytes, its bytes and, where ids repeat, ``sub``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = length - gram_width(length) + 1
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ord", "sub", "body")]
            lists = batch.column("hashes")
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out: list[list] = [[], [], []]
            for i, (order, sub, body) in enumerate(zip(*columns)):
                own = minimizers(_bytes_of(body), length)
                if not len(own):
                    continue
                starts, ends = runs_of(own, longest)
                keys = shown(own[starts])
                shared = np.isin(keys, flat[bounds[i]:bounds[i + 1]])
                starts, ends = starts[shared], ends[shared]
                out[0] += (keys[shared] % parts).tolist()
                out[1] += [order] * len(starts)
                mark = sub.to_bytes(8, "little", signed=True) if sub else b""
                out[2] += [a.to_bytes(4, "little") + body[a:b + length - 1] + mark
                           for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, LONG) for c in out[:2]), pa.array(out[2], pa.binary())],
                                             names=["part", "ord", "context"])
    return run


def merge_shards(symbols: np.ndarray, lengths: np.ndarray, shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave sorted shards of suffixes.

    ``symbols`` holds each suffix's symbols, row by row, and ``shards`` the rows of each shard in
    sorted order. Returns the rows in merged order and, for each, the bytes that it has in
    common with the one before; ``lengths`` are the bytes that each symbol adds.
    """
    order = np.concatenate(shards)
    n = len(order)
    common = np.zeros(n, np.int64)
    begins = np.zeros(n, bool)  # first of its class
    if n:
        begins[0] = True
    for column, size in enumerate(lengths):
        alone = begins & np.append(begins[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        classes = np.cumsum(begins)[open_at]
        own = symbols[order[open_at], column]
        moved = np.lexsort((own, classes))  # stable: the shards' order stays within equal symbols
        order[open_at] = order[open_at][moved]
        own, classes = own[moved], classes[moved]
        splits = np.append(False, (own[1:] != own[:-1]) & (classes[1:] == classes[:-1]))
        begins[open_at[splits]] = True
        same = np.append(False, (own[1:] == own[:-1]) & (classes[1:] == classes[:-1]))
        common[open_at[same]] += size
    return order, common


def _symbols(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of ``length`` bytes and more of each context as rows of symbols, with the
    context and place of each."""
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8).astype(np.uint64)
    words = data[:-7]
    for k in range(1, 8):
        words = (words << np.uint64(8)) | data[k:len(data) - 7 + k]
    of = np.repeat(np.arange(len(contexts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[of] + place
    offsets = list(range(0, length - 7, 8))
    columns = [words[at + o] for o in offsets]
    added = [8] * len(offsets)
    if length % 8:
        columns.append(words[at + length - 8] if length >= 8 else words[at] >> np.uint64(8 * (8 - length)))
        added.append(length % 8)
    return np.stack(columns, 1), np.array(added), of, place


def earliest_documents(contexts: list[bytes], first_docs: np.ndarray, shard_of: np.ndarray,
                       length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of the contexts: its context, its place there, and the least document whose
    contexts hold the same ``length`` bytes."""
    symbols, added, of, place = _symbols(contexts, length)
    rows = np.arange(len(of))
    shards = []
    for shard in np.unique(shard_of):
        own = rows[shard_of[of] == shard]
        shards.append(own[np.argsort(symbols[own, 0], kind="stable")])
    order, common = merge_shards(symbols, added, shards)
    interval = np.cumsum(common < length) - 1
    docs = first_docs[of[order]]
    least = np.full(interval[-1] + 1 if len(interval) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, interval, docs)
    out = np.empty(len(of), np.int64)
    out[order] = least[interval]
    return of, place, out


def packed(start: int, stop: int) -> int:
    """A range in one long: its start and, in the low 31 bits, its length."""
    return start << 31 | (stop - start)


def _resolve(rows: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of bytes of (ord, sub, start, context) rows that start in an earlier document."""
    index: dict[bytes, int] = {}
    first: list[int] = []
    which = np.empty(len(rows), np.int64)
    for i, (order, _, _, context) in enumerate(rows):
        k = which[i] = index.setdefault(context, len(index))
        if k == len(first):
            first.append(order)
        elif order < first[k]:
            first[k] = order
    first_docs = np.array(first, np.int64)
    of, _, least = earliest_documents(list(index), first_docs, first_docs % SHARDS, length)
    begin = np.searchsorted(of, np.arange(len(index) + 1))
    for i, (order, sub, start, _) in enumerate(rows):
        c = which[i]
        hit = least[begin[c]:begin[c + 1]] < order
        if hit.all():
            yield order, sub, start, start + len(hit) + length - 1
        elif hit.any():
            steps = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
                yield order, sub, start + a, start + b + length - 1


def _resolver(length: int, ids_repeat: bool):
    """Contexts arrive sorted by part; whole parts are merged together. Gives rows (ord, sub, at)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, last = 0, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            found = list(zip(*((o, s, packed(a, b)) for o, s, a, b in _resolve(rows, length)))) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, LONG) for c in found], names=["ord", "sub", "at"])

        for batch in batches:
            for part, order, sent in zip(*(batch.column(c).to_pylist() for c in ("part", "ord", "context"))):
                if size > MERGED_AT_ONCE and part != last:
                    yield out(waiting)
                    waiting, size = [], 0
                end = len(sent) - 8 if ids_repeat else len(sent)
                waiting.append((order, int.from_bytes(sent[end:], "little", signed=True),
                                int.from_bytes(sent[:4], "little"), sent[4:end]))
                size += len(sent)
                last = part
        if waiting:
            yield out(waiting)
    return run


def _rows(docs: DataFrame, row, id_col: str, text_col: str) -> tuple[DataFrame, bool, int]:
    """(ord, sub, row, body), whether ids repeat, and the number of parts; ``sub`` tells texts of one id apart."""
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    facts = docs.groupBy(order.alias("ord")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("size"))
    most, size = facts.agg(F.max("n"), F.sum("size")).first()
    body = text_or_empty(text_col).cast("binary")
    # Odd, so never zero, where ids repeat.
    sub = F.xxhash64(body).bitwiseOR(F.lit(1)) if (most or 0) > 1 else F.lit(0).cast("long")
    return docs.select(order.alias("ord"), sub.alias("sub"), row.alias("row"), body.alias("body")), (most or 0) > 1, 1 + (size or 0) // TEXT_PER_PART


def with_earlier_ranges(rows: DataFrame, ids_repeat: bool, parts: int, length: int) -> DataFrame:
    """``rows`` (ord, sub, row, body) and ``ranges``: the bytes covered by strings of earlier documents.

    Both joins with the texts deal them out by ``ord`` with the same columns, so the texts
    are shuffled once.
    """
    ship_package(rows.sparkSession)
    found = rows.select("ord", "body").mapInArrow(_minimizer_rows(length), "hash bigint, ord bigint")
    same = Window.partitionBy("hash").orderBy("ord")
    shared = (found.withColumn("before", F.lag("ord").over(same)).withColumn("after", F.lead("ord").over(same))
              .where((F.col("before") < F.col("ord")) | (F.col("after") > F.col("ord"))).select("hash", "ord"))
    wanted = shared.groupBy("ord").agg(F.collect_list("hash").alias("hashes")).withColumnRenamed("ord", "w_ord")
    copies = None
    if not ids_repeat:  # whole copies of earlier documents go without being merged
        digests = rows.select("ord", F.octet_length("body").alias("n"), F.sha2("body", 256).alias("digest"))
        first = digests.groupBy("digest").agg(F.min("ord").alias("first")).withColumnRenamed("digest", "first_digest")
        copies = cut(digests.join(first, F.col("digest") == F.col("first_digest"))
                     .where((F.col("ord") > F.col("first")) & (F.col("n") >= length)).select(F.col("ord").alias("c_ord"), "n"))
        wanted = wanted.join(copies, F.col("w_ord") == F.col("c_ord"), "left_anti")
    contexts = rows.join(wanted, F.col("ord") == F.col("w_ord")).select("ord", "sub", "row", "body", "hashes").mapInArrow(
        _context_rows(length, parts), "part bigint, ord bigint, context binary")
    ranges = (contexts.repartition("part").sortWithinPartitions("part")
              .mapInArrow(_resolver(length, ids_repeat), "ord bigint, sub bigint, at bigint"))
    one = F.struct("sub", "at") if ids_repeat else F.col("at")
    if copies is not None:
        ranges = ranges.select("ord", "at").unionByName(
            copies.select(F.col("c_ord").alias("ord"), F.col("n").cast("long").alias("at")))
    lists = ranges.groupBy(F.col("ord").alias("r_ord")).agg(F.collect_list(one).alias("ranges"))
    return rows.join(lists, F.col("ord") == F.col("r_ord"), "left").select("ord", "sub", "row", "body", "ranges")


def keep_rest(body: bytes, sub: int, ranges: list | None) -> tuple[bytes, int, int]:
    """What is left of ``body``, the number of bytes removed, and of maximal removed runs."""
    own = sorted((r["at"] for r in ranges or () if r["sub"] == sub) if sub else ranges or ())
    if not own:
        return body, 0, 0
    parts, at, removed, spans = [], 0, 0, 0
    end = -1
    for at_range in own:
        start, stop = at_range >> 31, (at_range >> 31) + (at_range & 0x7FFFFFFF)
        if start > end:
            spans += 1
        if start > at:
            parts.append(body[at:start])
        removed += max(0, stop - max(start, at))
        at, end = max(at, stop), max(end, stop)
    parts.append(body[at:])
    return b"".join(parts), removed, spans


INPUTS = ("ord", "sub", "row", "body", "ranges")


def _reporter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for order, sub, _, body, ranges in zip(*(batch.column(c).to_pylist() for c in INPUTS)):
            rest, removed, spans = keep_rest(body, sub, ranges)
            out.append((None if order == LEAST_ID else order, len(body), removed, spans, hashlib.sha256(rest).hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, LONG) for c in columns[:4]), pa.array(columns[4], pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_report(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows, repeat, parts = _rows(docs, F.lit(True), id_col, text_col)
    return with_earlier_ranges(rows, repeat, parts, length).mapInArrow(
        _reporter, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _cleaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [keep_rest(body, sub, ranges)[0].decode("utf-8", "ignore")
                 for sub, body, ranges in zip(*(batch.column(c).to_pylist() for c in ("sub", "body", "ranges")))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "clean"])


def remove_earlier(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   length_col: str | None = "n_chars") -> DataFrame:
    """Every document without the strings that start in earlier ones; columns as given.

    Bytes of a character that is cut in two go with the cut.
    """
    others = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    rows, repeat, parts = _rows(docs, F.struct(others.alias("row"), F.col(text_col).isNull().alias("was_null")), id_col, text_col)
    clean = with_earlier_ranges(rows, repeat, parts, length).mapInArrow(
        _cleaner, f"row {rows.schema['row'].dataType.simpleString()}, clean string")
    text = F.when(F.col("row.was_null"), F.lit(None)).otherwise(F.col("clean"))
    fields = {c: text if c == text_col else F.col("row")["row"][c] for c in docs.columns}
    if length_col and length_col in docs.columns:
        fields[length_col] = F.length("clean").cast(docs.schema[length_col].dataType)
    return clean.select(*[c.alias(name) for name, c in fields.items()])
