"""The prefix trie against brute force, over blocks of a few rows, and its binary searches against scans."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from agonix.llm.prefix_trie import RangeMinimum, forked, prefix_trie, sequences


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()[:16], x or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = own + sum(saved[q] for q in children[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth int, Key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [2, 5, 1 << 16])
def test_random_conversations(spark, block):
    rng = random.Random(block)
    rows = []
    for c in [*range(60), *range(1000, 1010), -7, -5]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 12])):
            rows.append((c, t, rng.choice(["user", "tool", None]), rng.choice(["", "a", "b", "é", None])))
    rows += [(c, t, "user", "same") for c in range(2000, 2040) for t in range(4)]  # equal conversations over several blocks
    rows += [(c, 0, "user", "same") for c in range(2040, 2060)]  # those that end where others go on
    rows += [(3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 1, "user", "lost"), (3, 1, "a", "tie")]
    out = prefix_trie(forked(sequences(frame(spark, rows))), block=block)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert answers(out) == brute(rebuilt(rows))


@pytest.mark.parametrize("rows", [[], [(4, 0, "user", "x")], [(1, 0, "u", "x"), (2, None, None, None)], [(7, t, "u", str(t)) for t in range(300)]])
def test_small_tables(spark, rows):
    assert answers(prefix_trie(forked(sequences(frame(spark, rows))))) == brute(rebuilt(rows))


def test_extents_by_scan():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        lcp = rng.integers(0, 4, n)
        table = RangeMinimum(lcp)
        for row in range(n):
            for depth in range(5):
                left = right = row
                while left > 0 and lcp[left] >= depth:
                    left -= 1
                while right + 1 < n and lcp[right + 1] >= depth:
                    right += 1
                assert [int(x[0]) for x in table.extents(np.array([row]), np.array([depth]))] == [left, right]
                assert table.of(np.array([left]), np.array([right]))[0] == lcp[left : right + 1].min()
