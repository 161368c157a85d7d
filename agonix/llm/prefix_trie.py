"""The trie of conversation prefixes, from sorted sequences and the lengths of their common prefixes.

Every distinct sequence of the first d turns is a node of depth d; its members are the conversations that begin with it.
Turns are 128-bit digests of role and text. Conversations are sorted by their digests over range partitions (blocks), so
a node's members stand side by side; lcp[i] is how many turns row i shares with the row before it. In a block, a sparse
table of range minima over lcp answers every candidate prefix by two binary searches of its own, to the left and to the
right, for the outermost rows that still share it: no stack and no order among candidates. What a node says of its
subtree follows from its interval: sums of prefix sums, a second sparse table for the smallest member.

A node whose interval meets a block's border and goes on in the next block comes as one piece per block, named by the
digest of its prefix; pieces are added up. There are no more of them than a border row has turns. Nodes below such a
node look up their parent by a salted join. A list of ids that crosses blocks is hashed in order, piece by piece.

A conversation's digests and sizes (24 bytes a turn) are one value, as a text is; the members of a node are never collected.

Defined cases: rows without conv_id are left out; a null turn comes first, equal turns are ordered by role, then by digest;
null role or text is empty; repeated rows are turns of their own; an empty table gives no nodes, not even a root; a
conversation without turns is a member of the root alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

NOTHING = hashlib.sha256(b"").hexdigest()
#: Rows a block has about, and shares of a parent's children.
BLOCK, SALTS = 1 << 16, 32


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``: digest and text bytes of every turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    d = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), d.alias("d"), F.octet_length(text).cast("long").alias("n"))
    listed = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))))


def forked(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % every; h is crc32(c) % most. A shared
    start is copied to ``every`` conversations at most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    both = seqs.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


class RangeMinimum:
    """Sparse table: level k holds the minimum of every 2**k values in a row."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The minimum of each range, bounds included."""
        out = np.empty(len(left), self.levels[0].dtype)
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.levels[k][left[here]], self.levels[k][right[here] - (1 << k) + 1])
        return out

    def extents(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The outermost rows l <= row <= r for which all of values[l + 1 .. r] are at least ``depth``."""
        left, right, n = row.copy(), row.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            step, table = 1 << k, self.levels[k]
            back = left - step
            ok = (back >= 0) & (table[np.minimum(np.maximum(back + 1, 0), len(table) - 1)] >= depth)
            left = np.where(ok, back, left)
            on = right + step
            ok = (on < n) & (table[np.minimum(right + 1, len(table) - 1)] >= depth)
            right = np.where(ok, on, right)
        return left, right


def _shared(a: list[bytes], b: list[bytes]) -> int:
    if a == b:
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


_BLOCK = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("lcp", pa.int64()), ("sizes", pa.list_(pa.int64())), ("edge", pa.list_(pa.binary()))])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over a sorted block: lcp with the row before (-1 in the first row); ``edge`` is the first and last row's key."""
    held, before, place = None, None, 0
    for batch in batches:
        part, conv, keys, sizes = (c.to_pylist() for c in batch.columns)
        rows = [held] if held else []
        for p, c, k, s in zip(part, conv, keys, sizes, strict=True):
            rows.append((p, place, c, -1 if before is None else _shared(before, k), s, k if before is None else None))
            before, place = k, place + 1
        held = rows.pop() if rows else None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _BLOCK.types, strict=True)], schema=_BLOCK)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held[:5], before), _BLOCK.types, strict=True)], schema=_BLOCK)


_NODE = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("part", pa.int32()), ("ids", pa.string())]
)


def _prefix_names(key: list[bytes], most: int) -> list[bytes]:
    """A name for each prefix of 0 to ``most`` turns."""
    h, out = hashlib.sha256(), []
    for d in range(most + 1):
        out.append(h.copy().digest()[:16])
        if d < most:
            h.update(key[d])
    return out


def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the values first[row], first[row] + 1, ..., count[row] of them."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def _block_nodes(rows: pa.Table) -> pa.RecordBatch:
    """The nodes that begin in a block, and the block's pieces of those that came in from before."""
    part, before, after = (rows.column(c)[0].as_py() for c in ("part", "before", "after"))
    conv, lcp = (rows.column(c).to_numpy().copy() for c in ("conv_id", "lcp"))
    m, lcp[0] = len(conv), before
    sizes = rows.column("sizes").combine_chunks()
    n = sizes.value_lengths().to_numpy().astype(np.int64)
    offset = np.cumsum(n) - n
    total = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())]).astype(np.int64)
    upto = lambda i, d: total[offset[i] + d] - total[offset[i]]  # bytes of row i's first d turns
    all_rows = np.arange(m)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    members, fresh = sums(upto(all_rows, n)), sums(upto(all_rows, n) - upto(all_rows, np.maximum(lcp, 0)))
    leaves = sums(np.append(lcp[1:], after) < n)

    first = np.where(all_rows == 0, 0, lcp + 1)
    row, depth = _ragged(first, n - first + 1)
    shared, smallest = RangeMinimum(lcp), RangeMinimum(conv)
    left, right = shared.extents(row, depth)
    p_left, p_right = shared.extents(row, depth - 1)
    goes_on = lambda a, b, d: ((a == 0) & (d <= before), (b == m - 1) & (d <= after))
    come_in, go_out = goes_on(left, right, depth)
    p_in, p_out = goes_on(p_left, p_right, depth - 1)
    names = [_prefix_names(rows.column("edge")[i].as_py(), most) if most >= 0 else [] for i, most in ((0, before), (m - 1, after))]
    named = lambda d, a, b: [names[0][x] if i else names[1][x] if o else None for x, i, o in zip(d.tolist(), a.tolist(), b.tolist(), strict=True)]
    root = depth == 0

    longer = np.flatnonzero(n > lcp)
    begun = np.sort(lcp[longer] * (m + 1) + longer)  # rows that begin a child, by the child's parent depth
    until = lambda r: np.searchsorted(begun, depth * (m + 1) + r, side="right")
    children = until(right) - until(left) + ((lcp[left] <= depth) & (n[left] > depth))
    above = np.where(root, 0, upto(left, np.maximum(depth - 1, 0)))
    count = right - left + 1
    starts = depth > lcp[left]
    saved = members[right + 1] - members[left] - count * above - (fresh[right + 1] - fresh[left]) + np.where(starts, above - upto(left, np.maximum(lcp[left], 0)), 0)

    same = np.append(False, (lcp[1:] == n[1:]) & (n[1:] == n[:-1]))  # equal to the row before
    stop = np.append(np.flatnonzero(~same)[1:], m)[np.cumsum(~same) - 1]
    key = named(depth, come_in, go_out)
    ids = [None] * len(row)
    ends = [NOTHING] * len(row)
    for i in np.flatnonzero(n[left] == depth).tolist():
        of = ",".join(map(str, conv[left[i] : stop[left[i]]].tolist()))
        if key[i] is None:
            ends[i] = hashlib.sha256(of.encode()).hexdigest()
        else:
            ids[i] = of
    parent_key = named(np.maximum(depth - 1, 0), p_in & ~root, p_out & ~root)
    parent = pa.array(smallest.of(p_left, p_right), mask=root | p_in | p_out)
    made = [smallest.of(left, right), depth, parent, count, children, leaves[right + 1] - leaves[left], saved, ends, key, parent_key, np.full(len(row), part), ids]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, _NODE.types, strict=True)], schema=_NODE)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by block and place: one block at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and b > a and held[0].column(0)[0].as_py() != part[a]:
                yield _block_nodes(pa.Table.from_batches(held))
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield _block_nodes(pa.Table.from_batches(held))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (key, ids) sorted by key and block: the digest of each key's lists, comma-joined."""
    now, h = None, None
    done: list[tuple[bytes, str]] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["key", "ends_sha256"])
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if h:
                    done.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield make()
        done.clear()
    if h:
        done.append((now, h.hexdigest()))
        yield make()


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays share from the start."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("long")


def _seams(blocks: DataFrame) -> DataFrame:
    """Per block, how many turns its first row shares with the row before it and its last row with the row after it; -1
    at the ends of the table. One row a block."""
    edge = blocks.where("edge is not null").groupBy("part").agg(F.min_by("edge", "place").alias("first"), F.max_by("edge", "place").alias("last"))
    edge = stored(edge, "edges", narrow=True)
    number = edge.select("part").withColumn("i", F.row_number().over(Window.orderBy("part")))
    edge = edge.join(number, "part")
    ahead = edge.select((F.col("i") + 1).alias("i"), F.col("last").alias("last_before"))
    behind = edge.select((F.col("i") - 1).alias("i"), F.col("first").alias("first_after"))
    both = edge.join(ahead, "i", "left").join(behind, "i", "left")
    shared = lambda other, own: F.when(F.col(other).isNull(), -1).otherwise(_common(F.col(other), F.col(own))).cast("long")
    return both.select("part", shared("last_before", "first").alias("before"), shared("first_after", "last").alias("after"))


def prefix_trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of
    every node. seqs: conv_id and turns, as sequences() gives them, one row per conversation."""
    seqs = stored(seqs.select("conv_id", F.col("turns.d").alias("key"), F.col("turns.n").alias("sizes")), "sequences")
    n = max(partitions(seqs.sparkSession), seqs.count() // block + 1)
    ranged = seqs.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = ranged.select(F.spark_partition_id().alias("part"), "conv_id", "key", "sizes").mapInArrow(_neighbours, "part int, place long, conv_id long, lcp long, sizes array<long>, edge array<binary>")
    blocks = stored(blocks, "blocks")
    placed = blocks.join(F.broadcast(_seams(blocks)), "part").select("part", "place", "conv_id", "lcp", "sizes", "edge", "before", "after")
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, part int, ids string"
    nodes = stored(placed.repartition(n, "part").sortWithinPartitions("part", "place").mapInArrow(_nodes, schema), "nodes")

    pieces = nodes.where("key is not null")
    lists = pieces.where("ids is not null").select("key", "ids", "part").repartition(n, "key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(_hash_lists, "key binary, ends_sha256 string")
    whole = pieces.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    whole = stored(whole.join(lists, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "split", narrow=True)
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    split = whole.join(parents, "parent_key", "left").select(out)
    inside = nodes.where("key is null")
    below = inside.where("parent_key is not null").drop("parent_conv_id").withColumn("salt", F.pmod(F.hash("conv_id", "depth"), F.lit(SALTS)))
    below = below.join(parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["parent_key", "salt"]).select(out)
    return inside.where("parent_key is null").select(out).unionByName(below).unionByName(split)
