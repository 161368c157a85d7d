"""The registered queries themselves, on whole small tables, against the libraries, brute force and held-out labels."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agonix.llm.common import table, tokenizer_path
from agonix.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


@pytest.fixture(scope="module")
def coded(docs):
    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    ids = {d: tok.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    return ids, {d: tok.decode(i, skip_special_tokens=False) for d, i in ids.items()}


def little(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_bpe(spark, sf, docs, coded):
    ids, decoded = coded
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_bpe"](spark, sf).collect()}
    assert got == {d: (len(i), hashlib.sha256(little(i)).hexdigest(), hashlib.sha256(decoded[d].encode()).hexdigest()) for d, i in ids.items()}


def test_secret_scan(spark, sf, docs):
    kinds = {
        "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    order = list(kinds)
    for r in QUERIES["op2_secret_scan"](spark, sf).collect():
        spans = sorted((m.start(), order.index(k), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, docs[r.doc_id], re.ASCII) if ok(m))
        listed = ",".join(f"{order[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_near_dedup(spark, sf, docs):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        sets[d] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op5_minhash_near_dedup"](spark, sf).collect()}
    assert got == {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_warc(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    last = {}
    for p, x in pages.items():
        last[x] = max(p, last.get(x, p))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op6_warc"](spark, sf).collect()}
    assert got == {p: (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if last[x] == p else "revisit", None if last[x] == p else last[x]) for p, x in pages.items()}


def test_packing(spark, sf, coded):
    ids = {d: [*i, 1] for d, i in coded[0].items()}
    rows = QUERIES["op7_best_fit_packing"](spark, sf).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = {d: [(k, a, len(i[a : a + 4096]), zlib.crc32(little(i[a : a + 4096]))) for k, a in enumerate(range(0, len(i), 4096))] for d, i in ids.items()}
    assert {d: sorted(p) for d, p in pieces.items()} == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_search(spark, sf):
    rows = [(r[0], r[1]) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect() if r[1] is not None and None not in r[1]]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    norm = np.sqrt((x * x).sum(1))
    fit = np.isfinite(x).all(1) & (norm > 0)
    ids, x, norm = ids[fit], x[fit], norm[fit]
    got = defaultdict(list)
    for r in QUERIES["op9_ann_search"](spark, sf).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q] / (norm * norm[q])
        score[q] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        hit += len({v for _, v in got[ids[q]]} & set(best.tolist()))
        total += len(best)
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and hit >= 0.9 * total


def test_toxicity_of_held_out_documents(spark):
    """On 10,000 documents, of rows never trained on (those the contract names): some labels are noise, on documents without a
    rude word; of the toxic ones at least 80 % are found, of the others at most 1 % are taken for toxic."""
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op10_toxicity"](spark, sf)
    assert out.where(F.col("held_out") != (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)).count() == 0
    assert out.where("score < 0 or score > 1 or predicted <> if(score >= 0.5, 1, 0)").count() == 0
    held = out.where("held_out").join(table(spark, sf, "labels"), "doc_id").select("score", "toxic").collect()
    bad, good = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    assert sum(x >= 0.5 for x in bad) >= 0.8 * len(bad) > 0 and sum(x >= 0.5 for x in good) <= 0.01 * len(good)


def test_pages(spark, sf):
    """Pages with one article: the text of its paragraphs and headings, as a plain pattern reads them."""
    html = {r.page_id: r.html or "" for r in table(spark, sf, "pages").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op4_html_extract"](spark, sf).collect()}
    assert got.keys() == html.keys()
    from html import unescape

    for p, x in html.items():
        text, n = got[p]
        assert n == len(text)
        inner = re.search(r"<article>(.*)</article>", x, re.S)
        if inner and not re.search(r"<(nav|aside|form|footer|section|div|script|style)\b", inner[1]):
            blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|blockquote|table|tr|td)\b[^>]*>", inner[1])
            plain = [" ".join(unescape(re.sub(r"<br\s*/?>", " ", b) and re.sub(r"<[^>]*>", "", re.sub(r"<!--.*?-->", "", re.sub(r"<br\s*/?>", " ", b), flags=re.S))).split()) for b in blocks]
            assert text == "\n".join(b for b in plain if b)
