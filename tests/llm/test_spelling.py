"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from promospark.llm.spelling import SYMBOLS, _by_length, _values, neighbour_codes, spelling_variants, symbol_of, variants

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if one_edit(w, x))
        near[w] = len(close)
        form[w] = close[0][1] if close and -close[0][0] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, near[w], words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_neighbourhoods_are_whole_and_without_repeats():
    rng = random.Random(1)
    words = ["".join(rng.choice(SYMBOLS[:rng.choice([1, 2, 8])]) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    words.append("01" * 40)

    def code(w):
        return int(_values(np.array([[int(c) + 1 for c in w]], np.uint64).reshape(1, -1))[0][0, -1])

    for places, digits in _by_length(words):
        rows, codes = neighbour_codes(digits)
        for k, place in enumerate(places.tolist()):
            w = words[place]
            want = {w} | {w[:i] + w[i + 1:] for i in range(len(w))}
            want |= {w[:i] + c + w[i + e:] for i in range(len(w) + 1) for c in SYMBOLS for e in (0, 1)}
            got = codes[rows == k].tolist()
            assert len(got) == len(set(got)) == len(want) and set(got) == {code(x) for x in want}


def test_equal_to_brute_force(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    words = stems + ["".join(rng.choice(w) if rng.random() < .2 else c for c in w) for w in stems * 6]
    weights = [1 / (1 + k % 37) for k in range(len(words))]
    rows = [(i, " ".join(w.upper() if rng.random() < .1 else w for w in rng.choices(words, weights, k=rng.choice([0, 5, 200, 800]))))
            for i in range(120)]
    rows += [(None, "Ébauche ébauche EBAUCHE ebauche ebauche"), (7000, None), (7001, ""), (7002, "1 2 3"), rows[3], rows[3],
             (7003, "×÷×÷× " * 4 + "x" * 300 + " " + ("y" * 299 + " ") * 3 + ("y" * 300 + " ") * 9)]
    got = found(spelling_variants(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "'s' AS root").repartition(7)))
    want = brute(rows)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 40 and any(v[1] not in (w, v[0]) for w, v in want.items())


def test_long_texts_are_counted_whole(spark):
    text = "needle haystack " * 200_000 + "Ending ending ending"
    got = found(spelling_variants(spark.createDataFrame([(1, text)], SCHEMA)))
    assert got == brute([(1, text)]) and sum(v[2] for v in got.values()) >= 400_000


def test_ties_chains_and_empty_tables(spark):
    def run(words):
        return found(variants(spark.createDataFrame(words, "word string, n long")))
    got = run([("aaaab", 3), ("aaaac", 9), ("aaaad", 9), ("aaaadd", 18), ("aaaaddd", 36), ("zzzzz", 4)])
    assert got["aaaab"] == ("aaaac", "aaaac", 3, 2, 9)  # equal counts: the lower word
    assert got["aaaad"] == ("aaaadd", "aaaaddd", 9, 3, 18) and got["aaaaddd"][:2] == (None, "aaaaddd")
    assert got["aaaac"][0] is None and got["zzzzz"] == (None, "zzzzz", 4, 0, None)
    # 12 steps, and two equal letters of one symbol
    chain = [("k" * (5 + i), 3 * 2 ** i) for i in range(13)]
    assert all(r[1] == "k" * 17 for r in run(chain).values())
    alike = next((a, b) for a in "abcdefgh" for b in "ijklmnop" if symbol_of(a) == symbol_of(b))
    assert run([(f"word{alike[0]}", 3), (f"word{alike[1]}", 7)])[f"word{alike[0]}"][0] == f"word{alike[1]}"
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(empty).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
