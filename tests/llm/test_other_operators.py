"""Language identification, chat formatting, HTML text, nearest neighbours and the pipeline."""

import json
import random

import duckdb
import numpy as np
import pytest

from promospark.llm import oracle
from promospark.llm.chat import formatted_chats
from promospark.llm.language import identify, language_filter
from promospark.llm.nearest import nearest
from promospark.llm.ngram_join import drop_similar
from promospark.llm.quality import quality_report
from promospark.llm.wrappers import extract, main_text, merge, of_page, parse, restored, slot_paths, stored
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = docs.withColumn("truth", F.col("lang")).withColumn(
        "lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang")))
    found = {r.doc_id: r for r in identify(hidden).collect()}
    held = [r for r in hidden.where("doc_id % 5 = 0").collect()]
    assert len(found) == docs.count()
    assert sum(found[r.doc_id].language == r.truth for r in held) >= 0.97 * len(held)
    assert sum(found[r.doc_id].accepted for r in held) >= 0.99 * len(held)


def test_language_evidence_and_edges(spark):
    rng = random.Random(4)
    words = {"xx": ["vowel", "tree", "ring", "stone"], "yy": ["zqua", "kyrt", "wuxo", "jipf"]}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k, f"www.{k}.site.{'ab'[k == 'yy']}")
            for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(500, "0 1 2", "yy", "www.yy.site.b"), (501, None, None, None), (502, "", "xx", "other.b"), (503, "?!", None, None),
             (504, " ".join(words["yy"] * 5), None, "host.b"), (505, "vowel tree " * 5000, None, None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "1 AS host", "'p' AS prior", "2 AS parent", "3 AS suffix")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert all(got[i].language == r[2] and got[i].accepted for i, r in enumerate(rows[:120]))
    assert got[500].language == "yy" and not got[500].accepted  # letterless: the other evidence decides
    assert got[504].language == "yy" and got[505].language == "xx" and got[505].accepted
    assert not any(got[i].accepted for i in (501, 502, 503))
    kept = language_filter(df)
    assert kept.columns == df.columns and kept.count() == 123  # the 120, one of them twice, and 504 and 505
    assert identify(df.limit(0)).collect() == []
    unlabelled = identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlabelled) == len(rows) and not any(r.accepted for r in unlabelled)


def test_every_declared_language_has_a_model(spark):
    rng = random.Random(12)
    codes = [a + b for a in "abcdefghij" for b in "qrstuvw"]  # 70 languages of words of their own
    words = {c: ["".join(rng.choice(c + "aeiou") for _ in range(6)) for _ in range(30)] for c in codes}
    rows = []
    for k, c in enumerate(codes):
        for j in range(5 if k % 7 else 30):
            rows.append((len(rows), " ".join(rng.choices(words[c], k=40)), [c, c.upper(), f"{c}-US", f" {c}_x-y "][j % 4], None))
        rows += [(len(rows) + j, rows[-1][1], c, None) for j in range(3)]  # copies
    rows += [(90_000 + k, " ".join(words[c]), bad, None) for k, (c, bad) in enumerate(zip(codes, ["", "1", "x", "no language", None, "-en"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in identify(df).collect()}
    want = {i: primary for (i, _, lang, _) in rows[:-6] for primary in [lang.strip().lower().replace("_", "-").split("-")[0]]}
    assert all(got[i].language == c and got[i].accepted for i, c in want.items())
    assert all(got[90_000 + k].language == codes[k] for k in range(6))
    assert {r.language for r in got.values()} == set(codes)


def test_ties_go_to_the_first_language(spark):
    same = [(k, "one and the same words", lang, None) for k, lang in enumerate(["zz", "bb", "mm"] * 4)] + [(99, "one and the same words", None, None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(same, "doc_id long, text string, lang string, source string")).collect()}
    assert got[99].language == "bb" and got[99].posterior == 0.3333 and not got[99].accepted


def test_chats_equal_sql(spark):
    rng = random.Random(6)
    rows = []
    for c in range(40):
        base = [(["user", "assistant", "system", None][rng.randrange(4)], rng.choice(["a", "b", "", None, "long " * 50]))
                for _ in range(rng.randint(1, 7))]
        for copy in range(rng.randint(1, 3)):
            n = rng.randint(1, len(base))
            rows += [(c * 10 + copy, t + (copy == 1), role, text) for t, (role, text) in enumerate(base[:n])]
    rows += [(900, t, "user", f"turn {t}") for t in range(700)] + [(901, t, "user", f"turn {t}") for t in range(600)]
    rows += rows[:9] + [(902, 0, "user", "x"), (902, 0, "assistant", "x"), (903, None, None, None), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = formatted_chats(df.selectExpr("*", "1 AS place", "2 AS block"))
    conversations = df.toPandas().astype(object).where(lambda d: d.notna(), None)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(oracle.OP7_CHAT_FORMATTING)
    names = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
    assert len(conversations) == len(rows) and formatted_chats(df.limit(0)).collect() == []


def test_wrapper_inference():
    first = parse("<body><div class=menu><a href=/>x</a></div><article><h1>t</h1><p>one<p>two</article></body>")
    second = parse("<body><article><h1>u</h1><ul><li>1<li>2</ul><p>three</p></article><footer>f</footer></body>")
    wrapper = merge(of_page(first), of_page(second))
    body = wrapper[2][0]
    assert [(p[0], p[1]) for p in body[2]] == [("div.menu", "?"), ("article", "1"), ("footer", "?")]
    assert [(p[0], p[1]) for p in body[2][1][2]] == [("h1", "1"), ("ul", "?"), ("p", "+")]
    assert body[2][1][2][0][2][0][2] is None  # texts that differ became a slot
    groups = of_page(parse("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert json.dumps(groups[2][0][2]).startswith('[["()", "+"')
    assert extract(second, slot_paths(wrapper)) == "u\n1\n2\nthree"


PAGES = [
    ("http://h.example.com/1", "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav>menu</nav>"
     "<article><h1>A &amp; B</h1><p>x \n\t y<b>z</b><br>w<p>open<!-- no --><div class='ad'>buy</div><section class=comments>c"
     "</section></article><footer>&copy;</footer>", "A & B\nx yz\nw\nopen"),
    ("http://h.example.com/2", "<body><main><p>only main</p><form>f</form></main></body>", "only main"),
    ("http://i.example.com/", "<div id=sidebar>s</div><div><p>plain text here</p></div><ul><li><a href=x>link</a></ul>", "plain text here"),
    (None, None, ""), ("odd", "", ""), ("http://j.example.com", "just text & more", "just text & more"),
    ("http://j.example.com", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("http://k.example.com", "<article><p>&lt;tag&gt; caf&eacute;</p><p>1 < 2</p></article", "<tag> café\n1 < 2"),
]


def test_main_text(spark):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(PAGES)]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").selectExpr(
        "*", "1 AS host", "'w' AS wrapper", "'t' AS text")
    got = main_text(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.url, r.text, r.n_chars) == (PAGES[r.page_id][0], PAGES[r.page_id][2], len(PAGES[r.page_id][2])), r
    assert main_text(df.limit(0)).collect() == []


def test_alignment_decides_what_is_text(spark):
    notice = "All prices are given without any guarantee and may change on any day of the year."
    pages = [(i, f"http://t.example.com/{i}", f"<body class='no-sidebar'><article class='post-social'><div class='x7'>{notice}</div>"
              f"<h1>Title {i}</h1><div class='x8'>Buy now</div><p>body of page {i} {'word ' * 20}</p></article></body>")
             for i in range(5)]
    pages += [(10 + i, f"http://u.example.com/{i}", "<div class='layout-sidebar'><article><p>story " + f"{i} " * 30
               + "</p></article></div><p>Imprint</p>") for i in range(4)]
    same = "<article><p>a copy</p><p>of one text</p></article>"
    pages += [(20 + i, "http://v.example.com/", same) for i in range(5)]  # copies are not template
    pages += [(30 + i, f"http://w.example.com/{i}", f"<article><p>one long shared text</p></article><div class='ad'>{i}</div>")
              for i in range(4)]  # nor is a text that only the adverts differ around
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nbody of page {i} {'word ' * 20}".strip() for i in range(5))
    assert all(got[10 + i] == ("story " + f"{i} " * 30).strip() for i in range(4))
    assert all(got[20 + i] == "a copy\nof one text" for i in range(5))
    assert all(got[30 + i] == "one long shared text" for i in range(4))


def test_deep_pages(spark):
    def page(n, text):
        return (f"<article><p>{text}</p>" + "<div>" * n + "<aside>aside</aside>inside" + "</div>" * n
                + "<p>after the deep part</p></article><footer>f</footer>")

    rows = [(i, f"http://d.example.com/{i}", page(n, f"page {i}")) for i, n in enumerate((3, 199, 250, 5000, 5000, 60000))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"page {i}\ninside\nafter the deep part" for i in range(6)}
    twice = "<article>" + 2 * ("<div>" * 4000 + "x" + "</div>" * 4000) + "</article>"  # deep parts that follow each other
    assert extract(parse(twice), slot_paths(restored(stored(of_page(parse(twice)))))) == "x\nx"


def test_nearest_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest(df, F.col("vec_id") % 20 == 0, rows_at_once=700).collect()
    table = df.toPandas()
    x, ids = np.stack(table["embedding"].to_numpy()).astype(float), table["vec_id"].to_numpy()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        own = sorted(by_query[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits += len(best & {r.vec_id for r in own})
        assert all(abs(r.score - scores[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert hits >= 0.9 * 20 * len(by_query)


def test_nearest_edges(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(30)] + [(100 + i, [1.0] * 8) for i in range(30)]
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [1.0] * 7), (204, [1.0, None] * 4),
           (205, [1.0]), (None, [1.0] * 8), (20, [9.0] * 8)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS norm", "2 AS vector")
    got = nearest(df, F.col("vec_id") % 20 == 0, k=5, vector_col="embedding").collect()
    usable = vectors + [(20, [9.0] * 8)]
    for i in {v for v, _ in usable if v % 20 == 0}:
        own = [r for r in got if r.query_id == i]
        for start in range(0, len(own), 5):
            assert not any(r.vec_id == i for r in own)
        if i != 20:  # two rows have this id
            query = dict(vectors)[i]
            want = sorted((-float(np.dot(query, v)), j) for j, v in usable if j != i)[:5]
            assert [r.vec_id for r in sorted(own, key=lambda r: r["rank"])] == [j for _, j in want]
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"]) for r in nearest(few, F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2)]
    assert nearest(few.limit(0), F.col("vec_id") == 0).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality_report(docs).collect()}
    after = docs
    counts = []
    for name, stage in P.STAGES[:-1]:
        before = after
        after = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        assert after.columns == docs.columns
        counts.append(after.count())
        if name == "quality rules":
            assert {r.doc_id for r in after.collect()} == {i for i, k in verdict.items() if k}
    assert counts == sorted(counts, reverse=True) and counts[1] >= 0.97 * counts[0] and counts[2] == counts[3]
    pieces = P.STAGES[-1][1](spark, after, SF).collect()
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert set(whole) == {r.doc_id for r in after.collect()}
    assert all(whole[r.doc_id] == r.doc_tokens for r in pieces)


def test_drop_similar_keeps_the_first(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(3, text, 1), (2, text + " more", 1), (9, "alone", 1), (9, "alone", 1), (10, None, 1)],
                               "doc_id long, text string, kept_id int")
    assert sorted((r.doc_id, r.text) for r in drop_similar(df).collect() if r.text) == [(2, text + " more"), (9, "alone")]
    assert drop_similar(df).count() == 3 and drop_similar(df).columns == df.columns


def test_missing_checkpoint_folder_is_an_error():
    from promospark.llm.common import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(type("S", (), {"sparkContext": Context()})())
