"""Quality rules and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agonix.llm import importance, quality_rules
from agonix.llm.common import table
from agonix.llm.queries import QUERIES

ODD = [
    None, "", " \n\t ", "one", "a b", "A\x00b a\x00B", "Ä ä İ ß é x", "x" * 70 + " " + "y" * 63 + " " + "z" * 64 + " q", "\x1c\x85 tab\tnl\n",
    "same line here\nsame line here\n\n \nsame line here\nother", "r e p e a t i t " * 4, "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 9 8", "a " * 9, "# $ % & | < > * ##",
    "w " * 3000, "der die und " * 30,
]


def base_counts(text):
    text = text or ""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(blank)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def frame(spark, texts, schema="doc_id long, text string, lang string, Kept int, n_words string"):
    return spark.createDataFrame([(i, t, ["en", None, "de"][i % 3], 1, "x") for i, t in enumerate(texts)], schema)


def test_fixed_counts(spark):
    docs = frame(spark, [*ODD, *ODD])
    out = quality_rules.judge(docs, quality_rules.references(docs), ["doc_id"]).collect()
    assert len(out) == 2 * len(ODD)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(ODD[r.doc_id % len(ODD)]), ODD[r.doc_id % len(ODD)]
        assert not (r.kept and r.base_failed)


def jensen_shannon(p, q):
    p, q = np.array(p, float) / max(1, sum(p)), np.array(q, float) / sum(q)
    m = (p + q) / 2
    return math.sqrt(max(0, sum((x * math.log2(x / y) if x else 0) for x, y in [*zip(p, m), *zip(q, m)]) / 2))


def test_registered_query_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in table(spark, sf, "documents").collect()]
    classes = [re.compile(x) for x in quality_rules.CLASSES.values()]
    chars = {d: [len(c.findall(t)) for c in classes] for d, t, _ in docs}
    words = {d: Counter(terms(t)) for d, t, _ in docs}
    references = []
    for lang in {x for _, _, x in docs}:
        own = [d for d, _, x in docs if x == lang]
        total = sum((words[d] for d in own), Counter())
        top = sorted(sorted(total), key=lambda w: -total[w])[:64]
        references.append((np.sum([chars[d] for d in own], axis=0), top, [*(total[w] for w in top), sum(total.values()) - sum(total[w] for w in top)]))
    got = {r.doc_id: r for r in QUERIES["op11_quality_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d, t, _ in docs:
        *counts, failed = base_counts(t)
        n, k = sum(chars[d]), sum(words[d].values())
        far = n >= 200 and min(jensen_shannon(chars[d], c) for c, _, _ in references) > 0.2 + math.sqrt(6 / (8 * math.log(2) * max(1, n)))
        mine = lambda top: [words[d][w] for w in top]
        far |= k >= 100 and min(jensen_shannon([*mine(top), k - sum(mine(top))], c) for _, top, c in references) > 0.1 + math.sqrt(64 / (8 * math.log(2) * max(1, k)))
        r = got[d]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts and r.base_failed == failed and r.kept == (not failed and not far)


def test_quality_labels(spark):
    """On 1000 documents, most bad ones go and nearly all good ones that are long enough stay."""
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op11_quality_rules"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("n_words >= 50")
    kept = {r.quality: (r.k, r.n) for r in out.groupBy("quality").agg(F.count_if("kept").alias("k"), F.count("*").alias("n")).collect()}
    assert kept[1][0] >= 0.98 * kept[1][1] and kept[0][0] <= 0.5 * kept[0][1]


def test_quality_of_nothing(spark):
    empty = frame(spark, [])
    assert quality_rules.judge(empty, quality_rules.references(empty), ["doc_id"]).count() == 0
    bare = frame(spark, ["a", None]).select("doc_id", "text")
    assert quality_rules.judge(bare, quality_rules.references(bare), ["doc_id"]).where("kept").count() == 0


def crcs(text, buckets=10000):
    w = terms(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, num=5, den=100):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(crcs(x))
    for x in target:
        t.update(crcs(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in crcs(x))
        rows.append((d, len(crcs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms(x))))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: num * len(fit) // den])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("texts", [[], ODD, [*ODD, *ODD, "one two three four five " * 9]])
def test_resampling_of_odd_texts(spark, texts):
    docs = frame(spark, texts, "doc_id long, text string, score string, `at` int, rank string").repartition(5)
    target = spark.createDataFrame([("one two three",), (None,)], "text string")
    got = importance.resample(docs, target, num=40)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == resampled(list(enumerate(texts)), ["one two three"], num=40)


def test_repeated_rows_can_all_be_drawn(spark):
    docs = spark.createDataFrame([(7, "one two three four five " * 5)] * 10 + [(None, "six " * 30)] * 10, "doc_id long, text string")
    got = importance.resample(docs, docs.limit(0), num=50).where("rank is not null").select("rank").collect()
    assert sorted(r["rank"] for r in got) == [*range(1, 11)]


def test_registered_resampling_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    target = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_importance_resampling"](spark, sf).collect()), key=str) == resampled(docs, target)
