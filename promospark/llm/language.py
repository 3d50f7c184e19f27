"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a document are multiplied: the likelihood of its text, of its
declared language, of its address's suffix, and the prior of its host. The text model
(hashed byte trigrams) is fitted for every declared language, on at most about
``LABELLED_DOCS`` of its distinct texts, chosen by hash; all else is computed from every
document. Declarations count by their primary subtag (``en-us`` and ``EN_GB`` are ``en``);
what isn't two to eight letters declares nothing. Texts are scored by ``MODELS_AT_ONCE``
languages at a time, so that the models sent to the tasks have a size bound. What the
text alone says, summed over documents by grouped aggregation, gives
P(declared | language), P(suffix | language) and the hosts' priors; a host's counts are smoothed
by its parent domain's, those by the whole table's.

The trigrams of a text depend on each other, so its likelihood counts as that of at
most ``EFFECTIVE`` independent ones. A document is rejected if it holds no letter or its best
language has less than ``MIN_POSTERIOR``.

Defined results: null, empty and letterless texts get the language that the other
evidence favours and are rejected; null declaration, address and host are neutral;
repeated rows are judged alike; of languages that are equally likely the first in
alphabetical order is given; texts of any length are scored whole; without any declared
language, all are rejected with a null language; an empty table gives no row; extra
columns are ignored by ``identify`` and kept by ``language_filter``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promospark.llm.common import cut, ship_package, text_or_empty

LABELLED_DOCS = 2000
BUCKETS = 1 << 14
EFFECTIVE = 40.0
TRIGRAMS_PER_EFFECTIVE = 4.0
MIN_POSTERIOR = 0.5
#: Languages whose models are broadcast together (16 MB).
MODELS_AT_ONCE = 256
HOST_WEIGHT = 20.0
SMOOTHING = 0.5
#: Bytes of a text that are looked up at once.
AT_ONCE = 1 << 20


def _buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the text with A-Z lower-cased, white space as spaces."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8)
    for start in range(0, max(len(data) - 2, 0), AT_ONCE):
        d = data[start:start + AT_ONCE + 2].astype(np.uint32)
        yield ((d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA6B) ^ d[2:] * np.uint32(0xC2B2AE35))
               >> np.uint32(18)).astype(np.int32)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("body").to_pylist()):
            own = counts.setdefault(label, np.zeros(BUCKETS, np.int64))
            for buckets in _buckets(text):
                own += np.bincount(buckets, minlength=BUCKETS)
    for label, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()),
                                          pa.array(own[at], pa.int64())], names=["label", "bucket", "n"])


def primary_subtag(declared: Column) -> Column:
    """The language that a declaration names: its letters before the first hyphen or underscore."""
    tag = F.regexp_extract(F.lower(F.trim(declared.cast("string"))), "^([a-z]{2,8})(?:[-_].*)?$", 1)
    return F.nullif(tag, F.lit(""))


def _log_shares(counts: pd.DataFrame) -> pd.DataFrame:
    """One language's model, from at most ``BUCKETS`` rows."""
    table = np.full(BUCKETS, SMOOTHING)
    table[counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    shares = np.log(table / table.sum()).astype("<f4")
    return pd.DataFrame({"label": [counts["label"].iloc[0]], "model": [shares.tobytes()]})


def fit_text_model(rows: DataFrame) -> DataFrame:
    """(label, model): log P(trigram bucket | language) as floats, a row per language of rows (declared, body).

    The sample is drawn from a language's distinct texts, so copies of one are in it once or not at all."""
    ship_package(rows.sparkSession)
    labelled = rows.where(F.col("declared").isNotNull()).select("declared", "body", F.xxhash64("body").alias("hash"))
    sizes = labelled.groupBy("declared").agg(F.countDistinct("hash").alias("texts")).select(F.col("declared").alias("label"), "texts")
    place = F.pmod(F.xxhash64("hash"), F.lit(1_000_000))
    chosen = (labelled.join(F.broadcast(sizes), F.col("declared") == F.col("label"))  # a row per language
              .where(place * F.col("texts") < LABELLED_DOCS * 1_000_000)
              .groupBy("label", "hash").agg(F.first("body").alias("body")))
    return (chosen.select("label", "body").mapInArrow(_count_trigrams, "label string, bucket int, n bigint")
            .groupBy("label", "bucket").agg(F.sum("n").alias("n"))
            .groupBy("label").applyInPandas(_log_shares, "label string, model binary"))


def _scorer(model):
    """Rows with the log likelihoods of some languages put behind those in ``text_score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(model.value.T)
        for batch in batches:
            out = []
            for text, before in zip(batch.column("body").to_pylist(), batch.column("text_score").to_pylist()):
                total, n = np.zeros(table.shape[1]), 0
                for buckets in _buckets(text):
                    total += table.take(buckets, 0).sum(0, dtype=np.float64)
                    n += len(buckets)
                weight = min(n / TRIGRAMS_PER_EFFECTIVE, EFFECTIVE) / n if n else 0.0
                out.append(before + np.round(total * weight, 6).tolist())
            at = batch.schema.names.index("text_score")
            yield batch.set_column(at, "text_score", pa.array(out, pa.list_(pa.float64())))
    return run


def _scored(rows: DataFrame, models: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` without body, with ``text_score``: log likelihoods by language, the best being 0."""
    out = rows.withColumn("text_score", F.array().cast("array<double>"))
    for k in range(0, len(languages), MODELS_AT_ONCE):
        some = languages[k:k + MODELS_AT_ONCE]
        found = {r.label: np.frombuffer(r.model, "<f4") for r in models.where(F.col("label").isin(some)).collect()}
        model = rows.sparkSession.sparkContext.broadcast(np.stack([found[x] for x in some]))
        out = out.mapInArrow(_scorer(model), out.schema)
    best = F.array_max("text_score")
    return out.drop("body").withColumn("text_score", F.transform("text_score", lambda x: F.round(x - best, 6)))


def _softmax(column: str) -> Column:
    """Posterior from log scores; the sums have a fixed order."""
    top = F.array_max(column)
    parts = F.transform(column, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def _soft_counts(scored: DataFrame, key: str, size: int) -> DataFrame:
    """(key, counts): what the texts of each key's documents say, in thousandths, so that sums are exact."""
    return scored.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_key")).agg(
        F.array(*[F.sum(F.round(F.col("text_posterior")[k] * 1000).cast("long")) / F.lit(1000.0) for k in range(size)])
        .alias(f"{key}_counts"))


def _log_share(counts: Column, totals: list[float], kinds: int) -> Column:
    """log P(value | language) from the counts of that value."""
    weights = F.array(*[F.lit(t + SMOOTHING * (kinds + 1)) for t in totals])
    return F.zip_with(counts, weights, lambda c, t: F.log((c + SMOOTHING) / t))


def identify(docs: DataFrame, key: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
             declared_col: str = "lang", address_col: str = "source") -> DataFrame:
    """doc_id, language, posterior, text_language, accepted for every row.

    ``address_col`` holds a host name or an URL; its last label is a suffix where there
    is more than one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    address = F.lower(F.col(address_col).cast("string"))
    host = F.nullif(F.regexp_replace(F.regexp_replace(address, r"^[a-z][a-z0-9+.-]*://", ""), r"[/:?#].*$", ""), F.lit(""))
    rows = docs.select((key if key is not None else F.col(id_col)).alias("doc_id"),
                       primary_subtag(F.col(declared_col)).alias("declared"), host.alias("host"),
                       text_or_empty(text_col).alias("text"))
    dotted = F.size(F.split("host", r"\.")) > 1
    rows = rows.select("doc_id", "declared", "host", F.when(dotted, F.substring_index("host", ".", -2)).alias("parent"),
                       F.when(dotted, F.substring_index("host", ".", -1)).alias("suffix"),
                       F.col("text").rlike(r"\p{L}").alias("has_letter"), F.col("text").cast("binary").alias("body"))
    models = cut(fit_text_model(rows))
    languages = sorted(r.label for r in models.select("label").collect())
    if not languages:
        return rows.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
                           F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    size = len(languages)
    scored = cut(_scored(rows, models, languages).withColumn("text_posterior", _softmax("text_score")))
    whole = scored.agg(*[F.sum(F.round(F.col("text_posterior")[k] * 1000).cast("long")).alias(f"k{k}") for k in range(size)]).first()
    totals = [(x or 0) / 1000.0 for x in whole]
    everything = [(t + 1.0) / (sum(totals) + size) for t in totals]
    joined = scored
    for kind in ("declared", "suffix", "parent", "host"):
        joined = joined.join(_soft_counts(scored, kind, size), F.col(kind) == F.col(f"{kind}_key"), "left")
    flat = F.array(*[F.lit(0.0)] * size)

    def smoothed(counts: Column, prior: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda c, p: (c + HOST_WEIGHT * p) / (n + HOST_WEIGHT))

    base = F.array(*[F.lit(p) for p in everything])
    joined = joined.withColumn("prior", smoothed(F.coalesce("parent_counts", flat), base))
    joined = joined.withColumn("prior", smoothed(F.coalesce("host_counts", flat), F.col("prior")))
    kinds = scored.agg(F.countDistinct("declared"), F.countDistinct("suffix")).first()
    for kind, n in zip(("declared", "suffix"), kinds):
        joined = joined.withColumn(f"{kind}_log", F.when(
            F.col(kind).isNotNull(), _log_share(F.col(f"{kind}_counts"), totals, n)).otherwise(flat))
    parts = F.arrays_zip(F.col("text_score").alias("a"), F.col("prior").alias("b"), F.col("declared_log").alias("c"),
                         F.col("suffix_log").alias("d"))
    fused = (joined.withColumn("fused", F.transform(parts, lambda x: x["a"] + F.log(x["b"]) + x["c"] + x["d"]))
             .withColumn("p", _softmax("fused")))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_max("p")
    return fused.select(
        "doc_id", F.get(names, (F.array_position("p", best) - 1).cast("int")).alias("language"),
        F.round(best, 4).alias("posterior"),
        F.get(names, (F.array_position("text_score", F.array_max("text_score")) - 1).cast("int")).alias("text_language"),
        (F.col("has_letter") & (best >= MIN_POSTERIOR)).alias("accepted"))


def language_filter(docs: DataFrame, text_col: str = "text", declared_col: str = "lang",
                    address_col: str = "source") -> DataFrame:
    """The accepted documents, with ``declared_col`` set to the language found; columns as given."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"),
                   F.col(declared_col).cast("string").alias("lang"), F.col(address_col).cast("string").alias("host"))
    flat_key = F.to_json(key)
    verdict = (identify(docs, flat_key, "doc_id", text_col, declared_col, address_col).where("accepted")
               .select(F.col("doc_id").alias("kept_key"), "language").dropDuplicates(["kept_key"]))
    rows = docs.select(F.struct("*").alias("row"), flat_key.alias("key"))
    joined = rows.join(verdict, F.col("key") == F.col("kept_key"))
    return joined.select(*[(F.col("language") if c == declared_col else F.col("row")[c]).alias(c) for c in docs.columns])
