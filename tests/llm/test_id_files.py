"""Coded id files: round trips, checksums, and the ids of the tokenizers library."""

import glob
import random
import zlib

import numpy as np
import pytest
from promospark.llm import id_files
from promospark.llm.common import tokenizer_path
from promospark.llm.context_coder import BLOCK, BadBlock, decode_blocks, encode_blocks
from promospark.llm.id_files import coded, documents, read_ids, write_ids
from promospark.llm.token_counts import load_tokenizer

SCHEMA = "doc_id long, text string"
PATH = tokenizer_path("byte_bpe_50k.json")


def blocks_of_many_kinds():
    rng = np.random.default_rng(1)
    text = rng.zipf(1.4, 20 * BLOCK) % 50_000
    kinds = [[5], [0], [2**32 - 1, 0], [1] * BLOCK, range(BLOCK), rng.integers(0, 2**32, BLOCK), rng.integers(0, 3, 5000),
             [7, 8] * 4000, *np.split(text, 20), text[:77]]
    return [np.array(k, np.uint32) for k in kinds]


def test_blocks_come_back_and_adapt():
    blocks = blocks_of_many_kinds()
    coded_blocks = encode_blocks(blocks)
    for got, want in zip(decode_blocks(coded_blocks), blocks):
        assert got.dtype == np.uint32 and np.array_equal(got, want)
    assert len(coded_blocks[3]) < 60 and len(coded_blocks[7]) < 60  # constant and alternating
    for text, size in zip(blocks[8:28], coded_blocks[8:28]):  # near the block's own entropy of order 0
        _, n = np.unique(text, return_counts=True)
        entropy = -(n * np.log2(n / len(text))).sum() / 8
        assert len(size) < 1.25 * entropy + 3 * len(n)
    for one, want in [*zip(coded_blocks, blocks)][4:7]:  # each can be read alone
        assert np.array_equal(decode_blocks([one])[0], want)


def test_damaged_blocks_are_refused():
    block = encode_blocks([np.arange(1000, dtype=np.uint32) % 17])[0]
    for at in range(0, len(block), 3):
        bad = bytearray(block)
        bad[at] ^= 4
        with pytest.raises(BadBlock):
            decode_blocks([bytes(bad)])


def test_frames(monkeypatch):
    monkeypatch.setattr(id_files, "FRAME_IDS", 1000)
    monkeypatch.setattr(id_files, "BLOCK", 300)
    rng = random.Random(2)
    docs = [(k if k else None, np.array([rng.randrange(60_000) for _ in range(rng.choice([0, 1, 10, 400, 2600]))], "<u4"))
            for k in range(60)] + [(90, np.empty(0, "<u4"))]
    content = b"\n".join([*coded((k, ids.tobytes()) for k, ids in docs), b""])
    start = 0
    for (doc_id, ids), (got_id, got_start, parts) in zip(docs, documents(content), strict=True):
        own = [*parts]
        assert (got_id, got_start) == (doc_id, start)
        assert np.array_equal(np.concatenate(own) if own else np.empty(0), ids)
        start += len(ids)
    assert list(documents(b"")) == []
    for bad in (content[:-1], content[:50], content[:-30], b"x" + content):
        with pytest.raises(BadBlock):
            for _, _, parts in documents(bad):
                list(parts)


def library(rows):
    tokenizer = load_tokenizer(PATH)
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]


def test_ids_of_the_library_in_order_of_ids(spark, tmp_path):
    rng = random.Random(3)
    odd = ["", None, " ", "\n\n", "a  b   c\t\t d\n \n e", "x<|endoftext|>y <|endoftext|>", "don't we'll 'tis I'M", "١٢٣ ⅷ ²³ 漢字かな 👩‍👩‍👧",
           "a\x85b c  d", "͸ ᲉꟋ", "é" * 3000, "word " * 400_000, "0123456789" * 50]
    rows = [(k * 3 - 20, " ".join(rng.choice(["the", "tion", "ément", ",", ".\n", "Große", "x1y2"]) for _ in range(rng.randrange(300))))
            for k in range(200)] + [(2000 + k, t) for k, t in enumerate(odd)] + [(None, "no id"), (5000, "same"), (5000, "same")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS start", "'p' AS part", "2 AS ids").repartition(5)
    write_ids(df, f"{tmp_path}/ids", PATH, files=4)
    got = sorted(read_ids(spark, f"{tmp_path}/ids", with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(library(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    start = 0
    for r, (_, ids) in zip(got, want):
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    plain = read_ids(spark, f"{tmp_path}/ids")
    assert plain.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and plain.count() == len(rows)


def test_empty_table_and_damaged_files(spark, tmp_path):
    write_ids(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", PATH)
    assert read_ids(spark, f"{tmp_path}/none").collect() == []
    write_ids(spark.createDataFrame([(1, "some text " * 50)], SCHEMA), f"{tmp_path}/one", PATH, files=1)
    name = max(glob.glob(f"{tmp_path}/one/part-*"), key=lambda p: len(open(p, "rb").read()))
    content = bytearray(open(name, "rb").read())
    content[len(content) // 2] ^= 1
    path = tmp_path / "bad"
    path.mkdir()
    (path / "part-00000").write_bytes(content)
    with pytest.raises(Exception, match="checksum"):
        read_ids(spark, str(path)).collect()
