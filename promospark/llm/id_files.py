"""Token-id files: documents' ids in ascending order of document id, coded in blocks.

A folder holds a file for each task of the sorted documents; names rise with the ids. A
file is a row of frames, each closed by a line end: a head (magic, documents, blocks,
bytes of the document table, checksum), the table of the documents that begin in the
frame (id, whether it is known, number of ids), and the blocks (see ``context_coder``),
each reset and checksummed by itself. Documents lie behind one another without gaps; a
document may go on in the next frame, but not in the next file.

Spark writes the files (its text sink writes bytes as they are) and reads them (its
binary source), so they survive lost tasks and lie in any store that Spark reaches.
A task holds one frame and one document at a time; files should stay under 2 GB, which
the number of shuffle partitions decides.

Defined results: null text is encoded as empty (the end id alone); a null document id
comes first; rows of equal id are separate documents, in order of their texts' hashes; an empty
table gives a folder without frames and no row; very long texts are encoded whole, some
words at a time; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promospark.llm.bpe_automaton import WORDS, disputed_characters
from promospark.llm.common import Remembered, cut, ship_package, text_or_empty
from promospark.llm.context_coder import BLOCK, LANES, BadBlock, block_size, decode_blocks, encode_blocks
from promospark.llm.token_counts import groups_by_size, load_tokenizer

MAGIC = b"IDCM"
FRAME = struct.Struct("<4sIIII")
FRAME_IDS = BLOCK * LANES
#: Words of a worker process whose ids are kept, and that are looked up at once.
KEPT_WORDS = 600_000
WORDS_AT_ONCE = 200_000


# ---------------------------------------------------------------------------
# Ids of texts


class WordIds(Remembered):
    """Ids, as bytes, of the words that the tokenizer's pattern cuts texts into; its merges don't cross them."""

    def __init__(self, path: str):
        super().__init__(KEPT_WORDS)
        self.tokenizer = load_tokenizer(path)
        self.words = regex.compile(WORDS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.disputed = frozenset(map(chr, disputed_characters()))

    def make(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _add(self, words: set[str]) -> None:
        missing = list(words.difference(self).difference(self.old))
        for group in groups_by_size(missing):
            for word, encoding in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False)):
                self.keep(word, array("I", encoding.ids).tobytes())

    def plain(self, text: str) -> bool:
        """Whether the pattern finds the library's words: no special strings, no character classed otherwise."""
        return not any(s in text for s in self.special) and (text.isascii() or self.disputed.isdisjoint(text))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        words = [self.words.findall(t) if self.plain(t) and len(t) < 8 * WORDS_AT_ONCE else None for t in texts]
        self._add(set().union(*(w for w in words if w is not None)))
        for text, own in zip(texts, words):
            if own is not None:
                yield b"".join(map(self.__getitem__, own))
            elif self.plain(text):
                yield b"".join(self._parts(text))
            else:
                yield self.make(text)

    def _parts(self, text: str) -> Iterator[bytes]:
        found = (m.group() for m in self.words.finditer(text))
        while some := list(islice(found, WORDS_AT_ONCE)):
            self._add(set(some))
            yield b"".join(map(self.__getitem__, some))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The store of a byte-level BPE file; kept per process."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


# ---------------------------------------------------------------------------
# Frames


def frame(docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """Bytes of ``ids`` and of the table of the documents (id, number of ids) that begin in them."""
    blocks = encode_blocks([ids[k:k + BLOCK] for k in range(0, len(ids), BLOCK)])
    table = np.zeros(len(docs), [("doc_id", "<i8"), ("known", "u1"), ("n", "<u8")])
    for k, (doc_id, n) in enumerate(docs):
        table[k] = (doc_id or 0, doc_id is not None, n)
    packed = zlib.compress(table.tobytes(), 1)
    head = MAGIC + struct.pack("<III", len(docs), len(blocks), len(packed))
    return b"".join([head, struct.pack("<I", zlib.crc32(head + packed)), packed, *blocks])


def frames(content: bytes) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The document table and the coded blocks of each frame of a file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if len(content) - at < FRAME.size:
            raise BadBlock("a frame is cut off")
        magic, n_docs, n_blocks, n_table, crc = FRAME.unpack_from(content, at)
        packed = bytes(view[at + FRAME.size:at + FRAME.size + n_table])
        if magic != MAGIC or zlib.crc32(content[at:at + FRAME.size - 4] + packed) != crc:
            raise BadBlock("a frame's head doesn't have its checksum")
        at += FRAME.size + n_table
        blocks = []
        for _ in range(n_blocks):
            if len(content) - at < 20:
                raise BadBlock("a frame is cut off")
            size = block_size(content, at)
            blocks.append(bytes(view[at:at + size]))
            at += size
        if content[at:at + 1] != b"\n":
            raise BadBlock("a frame isn't closed")
        at += 1
        yield np.frombuffer(zlib.decompress(packed), [("doc_id", "<i8"), ("known", "u1"), ("n", "<u8")]), blocks


def documents(content: bytes) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
    """Each document of a file: its id, the ids of the file before it, and its own ids in parts, to be taken at once."""
    waiting: deque = deque()
    parts: deque[np.ndarray] = deque()
    source = frames(content)

    def more() -> bool:
        found = next(source, None)
        if found is None:
            return False
        table, blocks = found
        waiting.extend((int(r["doc_id"]) if r["known"] else None, int(r["n"])) for r in table)
        for k in range(0, len(blocks), LANES):
            parts.extend(decode_blocks(blocks[k:k + LANES]))
        return True

    def own(n: int) -> Iterator[np.ndarray]:
        while n:
            if not parts and not more():
                raise BadBlock("a document is cut off")
            part = parts.popleft()
            if len(part) > n:
                parts.appendleft(part[n:])
                part = part[:n]
            n -= len(part)
            yield part

    start = 0
    while waiting or more():
        if waiting:
            doc_id, n = waiting.popleft()
            yield doc_id, start, own(n)
            start += n


def coded(stream: Iterator[tuple[int | None, bytes]]) -> Iterator[bytes]:
    """The frames of documents (id, little-endian unsigned 32-bit ids)."""
    docs: list[tuple[int, int | None, int]] = []  # where they begin, id, number of ids
    waiting: list[bytes] = []
    begun = held = 0  # ids in closed frames, and those that wait

    def closed(n: int) -> bytes:
        nonlocal docs, waiting, begun, held
        data = b"".join(waiting)
        own = [d for d in docs if d[0] < begun + n] if n < held else docs
        out = frame([d[1:] for d in own], np.frombuffer(data[:4 * n], "<u4"))
        docs, waiting, begun, held = docs[len(own):], [data[4 * n:]], begun + n, held - n
        return out

    for doc_id, ids in stream:
        n = len(ids) // 4
        docs.append((begun + held, doc_id, n))
        waiting.append(ids)
        held += n
        while held >= FRAME_IDS:
            yield closed(FRAME_IDS)
    if held or docs:
        yield closed(held)


# ---------------------------------------------------------------------------
# Spark


def _writer(path: str, end_id: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        store, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for group in groups_by_size(batch.column("body").to_pylist()):
                for ids in store.of(group):
                    yield next(doc_ids), ids + end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in coded(encoded(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary())], names=["frame"])
    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
              files: int | None = None) -> None:
    """Write the ids of ``docs`` to the new folder ``path``, in ``files`` files (None: as many as shuffle partitions)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))
    order = ["doc_id", F.xxhash64("body")]
    (rows.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
     .mapInArrow(_writer(tokenizer_path, end_id), "frame binary")
     .select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path))


def _reader(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int64()] * 5 + ([pa.list_(pa.int64())] if with_ids else [])

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for doc_id, start, own in documents(content.as_py()):
                    n = crc = 0
                    ids = []
                    for some in own:
                        n += len(some)
                        crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
                        if with_ids:
                            ids.append(some)
                    rows.append((part, doc_id, start, n, crc, *([np.concatenate(ids).astype(np.int64) if ids else []] if with_ids else [])))
                    held += 1 + (n if with_ids else 0)
                    if held >= WORDS_AT_ONCE:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)
    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the folder ``path``.

    ``start`` counts the ids of all documents before it. Every block is decoded and held against its checksums.
    """
    ship_package(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("part"), "content"))
    rows = cut(files.mapInArrow(_reader(with_ids), "part bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
                                + (", ids array<bigint>" if with_ids else "")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part").alias("file"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    return rows.join(starts, F.col("part") == F.col("file")).select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), *rows.columns[3:])
