"""Token counts through a digest cache.

Texts are normalised (null to empty; optionally by a Column function that keeps
counts), digested with SHA-256, and joined to stored counts under the digest of
the tokenizer's file and library version. One text of each missing digest is
encoded; the new counts are appended to the cache, a Parquet folder that all
executors share.

A digest that a third of all rows share is reduced in each task before the
shuffle; the rows themselves only carry digests through the joins. Repeated
entries in the cache (two jobs that ran at once) count once. Null text counts
as empty; repeated rows give repeated result rows.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promospark.llm.common import ensure_checkpoint_dir, ship_package, text_or_empty

CACHE_SCHEMA = T.StructType([
    T.StructField("tokenizer", T.StringType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("n_tokens", T.LongType()),
])

#: Characters handed to the tokenizer at once; bounds a task's memory, not its work.
ENCODE_CHARS = 2_000_000

_TOKENIZERS: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of the file and of the library version that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library}-{importlib.metadata.version(library)}".encode()).hexdigest()


def load_tokenizer(path: str):
    if path not in _TOKENIZERS:
        if path.endswith(".model"):
            import sentencepiece
            _TOKENIZERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _TOKENIZERS[path] = tokenizer
    return _TOKENIZERS[path]


def groups_by_size(texts: list[str], limit: int = ENCODE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters together, or one longer text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def count_tokens(path: str, texts: list[str]) -> list[int]:
    tokenizer = load_tokenizer(path)
    counts: list[int] = []
    for group in groups_by_size(texts):
        if path.endswith(".model"):
            counts += [len(ids) for ids in tokenizer.encode(group, num_threads=1)]
        else:
            counts += [len(e) for e in tokenizer.encode_batch_fast(group, add_special_tokens=False)]
    return counts


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(path, batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())],
                                             names=["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, cache_dir: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty where the folder is new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == tokenizer)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512,
                 normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    ``cache_dir`` is a durable shared folder; without it, a new one under
    ``spark.checkpoint.dir`` serves this call alone.
    """
    spark = docs.sparkSession
    ship_package(spark)
    cache_dir = cache_dir or f"{ensure_checkpoint_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_digest(tokenizer_path)
    body = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("raw"),
                       (normalise(body) if normalise else body).alias("body"))
    rows = rows.select("doc_id", "body", F.octet_length("raw").cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"))
    stored = read_cache(spark, cache_dir, version)
    chosen = (rows.select("digest", "doc_id").groupBy("digest").agg(F.min("doc_id").alias("chosen_id"))
              .join(stored, "digest", "left_anti")
              .select(F.col("digest").alias("chosen_digest"), "chosen_id"))
    misses = (rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id"))
                        & (F.col("digest") == F.col("chosen_digest")))
              .select("digest", "body"))
    encoded = misses.mapInArrow(_counter(tokenizer_path), "digest binary, n_tokens bigint")
    encoded = encoded.dropDuplicates(["digest"])  # rows of equal id and text
    (encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_dir))
    counts = read_cache(spark, cache_dir, version).withColumnRenamed("digest", "stored_digest")
    return (rows.select("doc_id", "n_bytes", "digest")
            .join(counts, F.col("digest") == F.col("stored_digest"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
