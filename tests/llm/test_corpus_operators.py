"""De-duplication, extraction, archives, search and toxicity against brute force, round trips and held-out rows."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from agonix.llm.ann import search
from agonix.llm.components import components
from agonix.llm.exact_dedup import dedup_exact
from agonix.llm.html_extract import Tree, _labels, _silver, extract, layouts, train
from agonix.llm.near_dedup import near_duplicates, needed
from agonix.llm.toxicity import Scorer, fit, fold, held_out
from agonix.llm.warc import archive_round_trip, parsed, read_archive, read_record, records, write_archive


def test_exact_dedup_with_ties_nulls_and_repeats(spark, tmp_path):
    rows = [(5, "a b", 1), (3, "ab", 1), (4, "a  b", 2), (9, "a\tb ", 1), (2, None, 1), (1, "", 1), (7, " ", 1), (3, "ab", 1), (None, "q", 1), (8, "q", 1), (11, "Zz", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    out = dedup_exact(spark, str(tmp_path / "t"), files_per_batch=1).collect()
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups["".join((t or "").split())].append((-len(t or ""), d is None, d or 0, d))
    want = sorted((str(d), str(min(groups["".join((t or "").split())])[3]), len(groups["".join((t or "").split())]), hashlib.sha256("".join((t or "").split()).encode()).hexdigest()) for d, t, _ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    df.where("false").write.parquet(str(tmp_path / "e"))
    assert dedup_exact(spark, str(tmp_path / "e")).count() == 0


def brute(rows, words):
    sets = []
    for d, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(low[find(i)] if d is not None else None)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    common = [word() for _ in range(60)]
    rows = [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "ONE"), (105, "Two words"), (None, "null id text here"), (106, "null id text here")]
    for g in range(12):
        base = [word() for _ in range(r.randint(3, 160))] + (common if g % 3 == 0 else [])
        for k in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                w[r.randrange(len(w))] = word()
            rows.append((1000 - 20 * g - k, " ".join(w)))
    rows.append(rows[-1])
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out) == brute(rows, words)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert needed(51, 64, 80, 100) == 41 and needed(1000, 64, 80, 100) < 41


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "é"), (5, "http://e", "é")]
    path = str(tmp_path / "w")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    back = read_archive(spark, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in parsed(back).collect()), key=str)
    d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got == sorted([(1, 8, d("<p>x</p>"), "revisit", 2), (2, 8, d("<p>x</p>"), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None), (5, 2, d("é"), "revisit", 5), (5, 2, d("é"), "response", None)], key=str)
    rec = {read_record(r.record, r.same)[0]: bytes(r.record) for r in records(back).collect() if b"http://e" not in r.record}
    head, _, block = rec[2].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and block == b"<p>x</p>\r\n\r\n" and b"Content-Length: 8" in head
    head, _, block = rec[1].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: revisit") and block == b"\r\n\r\n" and b"WARC-Profile: " in head and b"Content-Length: 0" in head


def test_warc_equal_rows_line_ends_and_shares(spark, monkeypatch):
    monkeypatch.setattr("agonix.llm.warc._SHARE", 4)
    odd = ["http://a\r\nWARC-Type: revisit", "%0A%250D%", "%2\r%25", "a\r\n\r\nb", " é ", ""]
    rows = [(7, "http://x", "same"), (7, "http://x", "same"), *((i, odd[i % 6], "hot") for i in range(30)), (None, None, "none"), (None, None, "none")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in archive_round_trip(frame).collect()]
    assert sorted((x[3], x[4]) for x in got if x[1] == 4 and x[0] == 7) == [("response", None), ("revisit", 7)]
    hot = {x[0]: x for x in got if x[1] == 3}
    assert len(hot) == 30 and all(hot[i][3:] == (("response", None) if i == 29 else ("revisit", 29)) + (odd[i % 6],) for i in range(30))
    assert sorted(x[3] for x in got if x[0] is None) == ["response", "revisit"] and len(got) == len(rows)
    assert {x[3] for x in archive_round_trip(frame, min_bytes=5).collect()} == {"response"}
    assert archive_round_trip(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        read_record(b"WARC/1.1\r\nWARC-Record-ID: <urn:x-page:1:2>\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")


def test_search_takes_vectors_of_extreme_length(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 1e200]), (2, [5e-324, 0.0]), (3, [1e308, -1e308]), (4, [float("inf"), 1.0])]
    got = {r.vec_id: r.score for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    want = {1: 3 / 10**0.5, 2: 1 / 5**0.5, 3: -1 / 10**0.5}
    assert set(got) == {1, 2, 3} and all(abs(got[k] - w / (1 if k != 1 else 1)) < 1e-12 for k, w in want.items())


def test_boilerplate_inside_articles_is_left_out():
    prose = "A long sentence about the matter at hand, with several words in it. Another one follows, and then a third."
    inner = '<section class="comments"><h3>Comments</h3><div class="comment"><p>What a fine piece, I liked it.</p></div></section><aside class="ad"><p>Buy this now, it is cheap.</p></aside><form class="signup"><p>Sign up for our letter.</p><input></form>'
    page = lambda i: f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p>{prose}</p>{inner}<p>{prose} End {i}.</p></article><footer>&copy; x</footer></body></html>"
    model = train([_silver(page(i)) for i in range(60)] + [Tree().read(h) for h in layouts()])
    assert model.extract(page(99)) == f"Title 99\n{prose}\n{prose} End 99."


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 24)).astype("f4")
    x[50:300] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(700, None), (750, [0.0] * 24), (800, [float("nan")] * 24), (850, [1.0, None] * 12), (None, [1.0] * 24), (3, [float(v) for v in x[3]])]
    out = defaultdict(list)
    for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, block=100, query_block=4).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(700), 3])
    y = np.vstack([x, x[3:4]]).astype(float)
    norm = np.sqrt((y * y).sum(1))
    hit = 0
    for q in range(0, 700, 50):
        score = (y * y[q]).sum(1) / (norm * norm[q])
        score[q] = -9
        best = np.lexsort((ids, -score))[:5]
        got = sorted(out[q])
        assert [g[2] for g in got] == [score[b] for b in best]
        hit += sum(g[1] == ids[b] for g, b in zip(got, best))
    assert set(out) == set(range(0, 700, 50)) and hit >= 0.9 * 70
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in search(few, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert search(few.where("false"), F.col("vec_id") == 0).count() == 0


def test_extraction_of_unseen_layouts_and_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = train([t for t in (_silver(r.html) for r in pages.collect()[:20]) if t] + [Tree().read(h) for h in layouts()])
    exact = 0
    for html in layouts(100, seed=77):
        tree = Tree().read(html)
        told = [False] * len(tree.parent)
        for i in range(1, len(told)):
            told[i] = told[tree.parent[i]] if tree.label[i] is None else tree.label[i]
        exact += tree.text(told) == model.extract(html)
    assert exact >= 95 and _labels(Tree().read("<p data-label=1>a</p>")).sum() >= 1
    for r in pages.collect()[20:]:
        tree = _silver(r.html)
        told = [False] * len(tree.parent)
        for i in range(1, len(told)):
            told[i] = told[tree.parent[i]] if tree.label[i] is None else tree.label[i]
        assert model.extract(r.html) == tree.text(told)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<article><p>a &amp;  b<br>c<p>d</article><nav>e</nav>", "x"), (4, "<<<>&#x41;", "x")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in extract(odd, model).collect()}
    assert got[1] == got[2] == "" and got[3] == "a & b c\nd"
    assert extract(odd.where("false"), model).count() == 0


@pytest.mark.parametrize("html", ["<p>a<noscript><p>b</p></noscript></p><p>rest of the article", "<p>a<noscript><div>b</div></noscript></p><p>rest of the article", "<ul><li>a<template><li>b</template></ul><p>rest of the article", "<p>a<object><canvas><div>b</div></canvas><p>b</object><p>rest of the article"])
def test_blocks_in_silent_elements_close_nothing_around_them(html):
    tree = Tree().read(html)
    assert tree.silent == 0 and tree.text([True] * len(tree.parent)) == "a\nrest of the article"


def test_toxicity_folding_phrases_and_held_out_rows(spark):
    assert fold("1D10T  Мoron, pàthetic!!") == "idiot moron pathetic"
    s = Scorer({"trash": 3.0, "idiot": 2.0}, ["trash can"])
    assert s.features("a trash can")[1] == 0 and s.features("tr4sh idiot!")[1] == 5.0 and s.features("idiotic trashy")[1] == 0 and s.features("") == (0.0, 0.0)
    r = random.Random(2)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(60)] + (["idiot", "trash"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame([*rows, (900, None, 0), (901, "idiot", None)], "doc_id long, text string, toxic int")
    out = {x.doc_id: x.score for x in fit(df.where("doc_id < 300 or doc_id >= 900")).score(df, ["doc_id"]).collect()}
    assert all((out[i] >= 0.5) == bool(y) for i, _, y in rows) and 0 <= out[900] < 0.5 and len(out) == 602
    empty = fit(df.where("false"))
    assert max(x.score for x in empty.score(df, ["doc_id"]).collect()) < 0.5 and empty.score(df.where("false"), ["doc_id"]).count() == 0
    assert 0.1 < df.agg(F.avg(held_out().cast("int"))).first()[0] < 0.3


def test_near_duplicates_keep_no_sketches_twice(spark, tmp_path, monkeypatch):
    """Sketches go once the classes have them, and both ways to bring the retained values together give the same."""
    from agonix.llm import common, near_dedup

    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(40)) for _ in range(30)]
    rows = [(i, texts[i % 30] + (" end" if i % 4 == 0 else "")) for i in range(90)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for most in (1 << 20, 0):
        monkeypatch.setattr(near_dedup, "_FEW_VALUES", most)
        monkeypatch.setattr(common, "shared_dir", lambda spark, most=most: f"file://{tmp_path}/{most}")
        got.append(sorted(near_duplicates(docs, words=2).collect()))
        left = [p.name for p in (tmp_path / str(most)).iterdir()]
        assert any("classes" in n for n in left) and not any("sketches" in n for n in left)
    assert got[0] == got[1] and len(got[0]) == 90
