"""Packing by power-of-two decomposition.

A document's ids, with the end id behind them, are cut into full pieces of
``max_length`` and the binary pieces of what remains, longest first. Each piece is
a sequence of its own, so no sequence crosses documents and none needs padding:
every length is a power of two. ``bucket`` (the binary logarithm of the length)
gathers sequences of one length, from which batches are drawn.

Each document is packed in the task that reads it; nothing is shuffled, whatever
its source or size. Null text is packed as empty (the end id alone); repeated
rows are packed once each; an empty table gives no piece; a very long text is packed
whole, in the memory of its task; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promospark.llm.common import Remembered, ship_package, text_or_empty
from promospark.llm.token_counts import groups_by_size, load_tokenizer

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def piece_lengths(n: int, max_length: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids; ``max_length`` is a power of two."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class ChunkIds(Remembered):
    """Ids, as little-endian bytes, of the chunks between spaces and line ends.

    The tokenizer's words never hold white space and its normaliser does not look
    past it, so a text's ids are its chunks' ids in order. Chunks met before are
    not encoded again.
    """

    def __init__(self, path: str, bound: int = 600_000):
        super().__init__(bound)
        self.tokenizer = load_tokenizer(path)

    def make(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def add(self, chunks: set[str]) -> None:
        """Encode together those that are not known."""
        missing = list(chunks.difference(self).difference(self.old))
        for group in groups_by_size(missing):
            for chunk, encoding in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False)):
                self.keep(chunk, array("I", encoding.ids).tobytes())

    def of(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, chunks))


#: The stores of the tokenizers that this process has used.
_STORES: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The store of a tokenizer file; kept per process, so that later tasks know what earlier ones met."""
    if path not in _STORES:
        _STORES[path] = ChunkIds(path)
    return _STORES[path]


#: A comma or full stop behind anything but a plain letter or digit: it may belong to a longer run of signs.
SIGNS_IN_A_ROW = re.compile("[^A-Za-z0-9À-ÖØ-öø-ÿ\\s][,.]")


def text_chunks(text: str) -> list[str]:
    """The pieces between spaces and line ends, commas and full stops at the ends of words apart where each is alone."""
    if not SIGNS_IN_A_ROW.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(",\n", " , ").replace(".\n", " . ")
    return text.replace("\n", " ").split(" ")


def _packer(path: str, max_length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = chunk_ids(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc_ids, done = batch.column("doc_id").to_pylist(), 0
            for group in groups_by_size(batch.column("body").to_pylist()):
                rows: list[tuple] = []
                chunks = [text_chunks(text) for text in group]
                store.add(set().union(*chunks))
                for own in chunks:
                    ids = store.of(own) + end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, max_length):
                        piece = ids[4 * start:4 * (start + length)]
                        row = (doc_ids[done], start, length, zlib.crc32(piece), n)
                        rows.append((*row, np.frombuffer(piece, "<i4")) if with_ids else row)
                        start += length
                    done += 1
                columns = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece. ``with_ids`` adds the ids themselves, to be written by ``write_buckets``.

    ``sequence_id`` is made of the task's number and the row's place in it; a task
    that is run again reads the same rows and gives the same numbers.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    ship_package(docs.sparkSession)
    pieces = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))
              .mapInArrow(_packer(tokenizer_path, max_length, end_id, with_ids),
                          PIECES + (", ids array<int>" if with_ids else "")))
    return (pieces.withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long"))
            .withColumn("bucket", (F.length(F.bin("length")) - 1).cast("int")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences of equal length in one folder each."""
    pieces.write.partitionBy("bucket").parquet(path)
