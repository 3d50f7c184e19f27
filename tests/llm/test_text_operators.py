"""Quality rules, token counts, packing, the BPE automaton and suffix dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from promospark.llm.bpe_automaton import compile_automaton, decode, encode, encode_digests
from promospark.llm.common import tokenizer_path
from promospark.llm.packing import ChunkIds, pack, piece_lengths, text_chunks, write_buckets
from promospark.llm.quality import QualityLimits, quality_filter, quality_report
from promospark.llm.suffix_dedup import merge_shards, remove_earlier, removal_report
from promospark.llm.token_counts import CACHE_SCHEMA, token_counts, tokenizer_digest

BYTE_BPE, WORD_BPE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

EDGE_TEXTS = [None, "", " ", "\n\n", "a", "é", "the 'll  x\t\ny\r\n", "日本語 テキスト　全角", "<|endoftext|>x<|endoftext|>",
              "a b c", "\U00014c8d࢏x", "word " * 3000, "ab" * 20000, "= # * $ % & | < >", "Ünïcode ΑΣ ΣΑ İ"]


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, 7, "x") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[4], rows[12], (None, "no id", None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, row string").withColumnsRenamed({})


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_base_measures_equal_brute_force(spark, edge_docs):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c dd e# f\n".split(" ")) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    for df in (docs, edge_docs):
        rows = quality_report(df).collect()
        assert len(rows) == df.count()
        want = by_id(df.collect())
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(
                want[r.doc_id].text), r


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    rng = random.Random(2)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))

    shared = [words(12) for _ in range(12)]
    rows = [(1000 + i, "\n".join([words(30), shared[i % 12], words(30)]), "h") for i in range(360)]
    rows += [(100 + i, "\n".join(x.upper() for x in rng.sample(shared, 6)) + f"\n{words(1)}\n" + words(3), "h")
             for i in range(80)]
    near = [words(20) for _ in range(5)]
    rows += [(200 + i, "\n".join([*near, words(9)]), "h") for i in range(40)]  # five shared lines, one own: boilerplate
    rows += [(2000 + i, "\n".join([*shared[:3], *near[:2], words(60)][::(-1) ** i]), "h") for i in [0] * 90]  # exact copies
    rows += [(300, rows[0][1], "other"), (301, "\n".join(shared), "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(quality_report(df).collect())
    assert all(got[i].kept and got[i].n_removed_lines == 1 for i in range(1000, 1360))
    assert all(not got[200 + i].kept and got[200 + i].n_removed_lines == 5 for i in range(40))
    assert all(not got[100 + i].kept and not got[100 + i].base_failed for i in range(80))
    assert got[300].kept and got[301].kept and got[301].n_removed_lines == 0
    kept = by_id(quality_filter(df.selectExpr("*", "0L AS n_chars", "1 AS hash", "2 AS row")).collect())
    assert set(kept) == {i for i, r in got.items() if r.kept}
    assert kept[1000].text == "\n".join(rows[0][1].split("\n")[::2]) and kept[1000].n_chars == len(kept[1000].text)
    assert quality_report(df.limit(0)).collect() == []


def test_lines_count_distinct_documents(spark):
    def page(i, shared, own, copies=1):
        lines = [" ".join(f"s{k}x{j}" for j in range(6)) for k in range(shared)]
        return [(i, "\n".join(lines + [f"own{i} {k} words" for k in range(own)]), "h")] * copies
    rows = [r for i in range(150) for r in page(i, 18, 2)]
    got = quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.n_removed_lines == 18 and not r.kept and not r.base_failed for r in got) and len(got) == 150
    # exact copies count as one document, in whatever order their lines stand
    copies = [(k, "\n".join(rows[0][1].split("\n")[::(-1) ** k]), "h") for k in range(150)]
    got = quality_report(spark.createDataFrame(copies, "doc_id long, text string, source string")).collect()
    assert all(r.n_removed_lines == 0 and r.kept for r in got) and len(got) == 150


def test_limits_are_parameters(spark):
    df = spark.createDataFrame([(1, "one two three", "s")], "doc_id long, text string, source string")
    assert quality_report(df, QualityLimits(min_words=2)).first().kept


def test_token_counts(spark, edge_docs, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time from the cache
        rows = token_counts(edge_docs, BYTE_BPE, cache).collect()
        assert len(rows) == edge_docs.count()
        texts = by_id(edge_docs.collect())
        for r in rows:
            text = texts[r.doc_id].text or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in EDGE_TEXTS} | {"no id"})
    digest = hashlib.sha256(b"planted").digest()
    spark.createDataFrame([(tokenizer_digest(BYTE_BPE), digest, 77)], CACHE_SCHEMA).write.mode("append").parquet(cache)
    planted = spark.createDataFrame([(1, "planted")], "doc_id long, text string")
    assert token_counts(planted, BYTE_BPE, cache).first().n_tokens == 77  # not encoded again
    assert token_counts(planted, WORD_BPE, cache).first().n_tokens != 77  # another tokenizer's count
    assert token_counts(planted, tokenizer_path("piece_bpe_32k.model"), cache).first().n_tokens > 0
    assert token_counts(planted.limit(0), BYTE_BPE, cache).collect() == []


def test_packing(spark, edge_docs, tmp_path):
    library = Tokenizer.from_file(WORD_BPE)
    pieces = pack(edge_docs, WORD_BPE, with_ids=True)
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    texts = Counter((r.doc_id, r.text) for r in edge_docs.collect())
    found = {}
    for r in rows:
        assert r.offset == 0 and r.length <= 2048 and r.length & (r.length - 1) == 0 and 1 << r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        found.setdefault(r.doc_id, []).append(r)
    for (doc_id, text), times in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(found[doc_id], key=lambda r: r.start)
        assert [i for r in own[::times] for i in r.ids] == ids and own[0].doc_tokens == len(ids)
    write_buckets(pieces.drop("ids"), str(tmp_path / "buckets"))
    assert spark.read.parquet(str(tmp_path / "buckets")).count() == len(rows)
    assert [sum(piece_lengths(n, 2048)) for n in (1, 2047, 2048, 5000)] == [1, 2047, 2048, 5000]
    assert pack(edge_docs.limit(0), WORD_BPE).collect() == []
    with pytest.raises(ValueError):
        pack(edge_docs, WORD_BPE, max_length=1000)


def test_chunks_give_the_ids_of_the_whole_text():
    library, store = Tokenizer.from_file(WORD_BPE), ChunkIds(WORD_BPE)
    rng = random.Random(8)
    pieces = ["word", "Élan", "l'été", "x1", "12", ",", ".", "...", "\"", "?", "_", "́", "ß", "ſ", "漢", "٣", " ", "\n", "\t", "\x85", "’s", "'S", "İ"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, [6, 2, 1, 1, 1, 6, 6, 1, 1, 1, 1, 1, 1, 1, 1, 1, 8, 4, 1, 1, 1, 1, 1], k=rng.randint(0, 14)))
        chunks = text_chunks(text)
        store.add(set(chunks))
        assert np.frombuffer(store.of(chunks), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_automaton_equals_the_library(spark, edge_docs):
    library, own = Tokenizer.from_file(BYTE_BPE), compile_automaton(BYTE_BPE)
    rng = random.Random(5)
    points = [chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(4000)]
    kinds = ["aaaa", "the ", "'ll", "  \n", "\t", "日本", "<|endoftext|>", "12", " "]
    for _ in range(1500):
        text = "".join(rng.choice(kinds) if rng.random() < 0.7 else rng.choice(points) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert own.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                     hashlib.sha256(text.encode()).hexdigest())
    ids = [rng.randrange(50257) for _ in range(200)]  # not a text's ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = encode_digests(edge_docs, BYTE_BPE).collect()
    assert len(rows) == edge_docs.count()
    texts = by_id(edge_docs.collect())
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id].text or "").encode()).hexdigest() for r in rows)
    back = by_id(decode(encode(edge_docs, BYTE_BPE), BYTE_BPE).collect())
    assert all(back[i].text == (r.text or "") for i, r in texts.items())
    assert encode_digests(edge_docs.limit(0), BYTE_BPE).collect() == []
    with pytest.raises(ValueError):
        compile_automaton(WORD_BPE)


def removed(rows, length):
    first, out = {}, []
    for i in sorted({i for i, _ in rows}, key=lambda i: (i is not None, i)):
        texts = [(t or "").encode() for j, t in rows if j == i]
        for b in texts:
            cover = bytearray(len(b))
            for s in range(len(b) - length + 1):
                if b[s:s + length] in first:
                    cover[s:s + length] = b"\1" * length
            rest = bytes(x for x, c in zip(b, cover) if not c)
            spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
            out.append((i, len(b), sum(cover), spans, hashlib.sha256(rest).hexdigest()))
        for b in texts:
            for s in range(len(b) - length + 1):
                first.setdefault(b[s:s + length], i)
    return out


@pytest.mark.parametrize("length", [50, 24, 7])
def test_suffix_dedup_equals_brute_force(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choices("abc é", k=rng.randint(30, 140))) for _ in range(12)] + ["a" * 300, "ab" * 120, "x" * length]
    rows = [(i * 2, "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choices("defgh ", k=rng.randint(0, 60)))
                            for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(3, rows[10][1]), (3, rows[11][1]), (500, None), (501, ""), (None, pool[0]), (502, "a" * (length - 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ord", "2L AS n_chars", "'k' AS ranges")

    def key(r):
        return r[0] is not None, r[0] or 0, r[1:]

    got = sorted((tuple(r) for r in removal_report(df, length).collect()), key=key)
    assert got == sorted(removed(rows, length), key=key)
    once = [r for r in rows if r[0] != 3] + [(600, rows[4][1]), (601, rows[4][1])]  # no id twice: copies go by digest
    unique = spark.createDataFrame(once, "doc_id long, text string")
    got = sorted((tuple(r) for r in removal_report(unique, length).collect()), key=key)
    assert got == sorted(removed(once, length), key=key)
    clean = remove_earlier(df, length)
    assert clean.dtypes == df.dtypes and clean.count() == len(rows)
    assert clean.where("doc_id = 500").first().text is None
    assert removal_report(df.limit(0), length).collect() == []


def test_merged_shards_are_sorted():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, (200, 5)).astype(np.uint64)
    shards = [np.flatnonzero(np.arange(200) % 4 == s) for s in range(4)]
    shards = [s[np.lexsort(symbols[s, ::-1].T)] for s in shards]
    order, common = merge_shards(symbols, np.full(5, 8), shards)
    rows = [tuple(symbols[i]) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 200):
        same = next((c for c in range(5) if rows[k][c] != rows[k - 1][c]), 5)
        assert common[k] == 8 * same
