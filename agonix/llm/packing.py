"""Best-fit packing of token pieces into sequences, by linear grouping.

1. Each document's ids, closed by an end token, are cut into pieces of at most ``capacity`` tokens.
2. The histogram of piece lengths (at most ``capacity`` entries, whatever the number of documents) goes to the driver.
3. Lengths over ``small`` are split by rank into ``groups`` of about equal cardinality, each rounded up to its longest.
4. Configurations of these few sizes are optimised one after another: an exact knapsack finds the fullest one, with
   sizes in stock, and it is used as often as the stock allows.
5. Actual documents take the slots of their group by rank, which leaves at least the rounded room.
6. Small pieces go, longest first, where they fit best: this too is decided on counts by length and by room, as
   segments of ranks. New sequences are opened only for what fits nowhere.

Spark does the ranking and the joins by (class, rank); the driver sees only counts bounded by ``capacity``.

Defined cases: a null or empty text is one piece, the end token alone; repeated rows with one doc_id are packed each
for itself; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encode, unpack
from .common import partitions, stored, tokenizer_path

_PIECE = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 and, if wanted, the packed ids of every piece."""
    schema = _PIECE if with_ids else T.StructType(_PIECE.fields[:-1])
    tail = np.array([end_id], dtype="<u4")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            for row, doc, packed in zip(*(batch.column(batch.schema.names.index(n)) for n in ("row", "doc_id", "ids")), strict=True):
                ids = np.concatenate([unpack(packed.as_py()), tail])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    values = (row.as_py(), doc.as_py(), k, at, len(part) // 4, zlib.crc32(part), part)
                    for f, v in zip(schema.fields, values, strict=False):
                        out[f.name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")), *([pa.array(out["ids"], pa.binary())] if with_ids else [])], names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(rows, path=path or tokenizer_path(), then=(split, schema))


def _ranked(df: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within each key, without bringing a key's rows together: rows are ranked within
    (key, bucket), and the buckets' counts give the offsets."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy(key, "_b").orderBy(*order)
    counts = df.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_r", F.row_number().over(inner) - 1)
    return df.join(offsets.select(key, "_b", F.coalesce("_off", F.lit(0)).alias("_off")), [key, "_b"]).withColumn("rank", (F.col("_off") + F.col("_r")).cast("long")).drop("_b", "_r", "_off")


def grouped(counts: dict[int, int], small: int, groups: int) -> list[tuple[int, int, int]]:
    """(lowest length, rounded length, pieces) of each group of large lengths, longest first; cut at lengths, by rank."""
    large = sorted((n for n in counts if n > small), reverse=True)
    size = max(1, -(-sum(counts[n] for n in large) // groups))
    out, top, have = [], None, 0
    for n in large:
        top, have = top or n, have + counts[n]
        if have >= size:
            out.append((n, top, have))
            top, have = None, 0
    if have:
        out.append((large[-1], top, have))
    return out


def configurations(sizes: list[int], stock: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations {group: how many} and how often each is used; every unit of stock is used once."""
    left, out = list(stock), []
    while any(left):
        # Exact bounded knapsack that starts with the longest size in stock, so long pieces don't pile up at the end.
        first = next(i for i, n in enumerate(left) if n)
        best: list[tuple[int, int] | None] = [None] * (capacity + 1)  # room used -> (group added last, room before)
        start = sizes[first]
        best[start] = (first, 0)
        reach = np.zeros(capacity + 1, dtype=bool)
        reach[start] = True
        for i in range(first, len(sizes)):
            s, most = sizes[i], left[i] - (i == first)
            for _ in range(min(most, (capacity - start) // s if s else 0)):
                new = np.zeros_like(reach)
                new[s:] = reach[:-s]
                new &= ~reach
                if not new.any():
                    break
                for r in np.flatnonzero(new):
                    best[r] = (i, int(r) - s)
                reach |= new
        used: dict[int, int] = defaultdict(int)
        at = int(np.flatnonzero(reach)[-1])
        while at:
            i, before = best[at]
            used[i] += 1
            at = before
        times = min(left[i] // n for i, n in used.items())
        for i, n in used.items():
            left[i] -= n * times
        out.append((dict(used), times))
    return out


def best_fit(rooms: dict[int, int], items: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, how many, class, first rank in class, offset), longest items first.

    A class is the room that sequences had at first; class ``capacity`` + 1 holds the new ones. A segment lays the
    items of those ranks one by one into sequences of those ranks."""
    new = capacity + 1
    at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room now -> (class, first rank, how many)
    for r, n in rooms.items():
        if r > 0 and n:
            at[r].append((r, 0, n))
    out, opened = [], 0
    for length in sorted(items, reverse=True):
        rank, left = 0, items[length]
        while left:
            room = min((r for r in at if r >= length), default=None)
            if room is None:
                each = min(capacity // length, left)
                many = left // each
                for k in range(each):
                    out.append((length, rank + k * many, many, new, opened, k * length))
                at[capacity - each * length].append((new, opened, many))
                opened, rank, left = opened + many, rank + each * many, left - each * many
                continue
            cls, first, n = at[room].pop()
            use = min(n, left)
            if use < n:
                at[room].append((cls, first + use, n - use))
            if not at[room]:
                del at[room]
            out.append((length, rank, use, cls, first, capacity - room))
            if room > length:
                at[room - length].append((cls, first, use))
            rank, left = rank + use, left - use
        at.pop(0, None)
    return out


def _lookup(df: DataFrame, key: str, segments: dict[int, list[tuple]], names: list[str]) -> DataFrame:
    """Find each row's segment by key and rank: a row of ``segments[key]`` is (first rank, *values). The segments are
    bounded by the capacity, not by the rows, and travel with the function."""
    tables = {k: (np.array([x[0] for x in v], dtype=np.int64), np.array([x[1:] for x in v], dtype=np.int64).reshape(len(v), -1)) for k, v in ((k, sorted(v)) for k, v in segments.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranks = (np.asarray(batch.column(batch.schema.names.index(n))) for n in (key, "rank"))
            found = np.zeros((len(keys), len(names) + 1), dtype=np.int64)
            for k in np.unique(keys):
                mine = np.flatnonzero(keys == k)
                firsts, values = tables[int(k)]
                i = np.searchsorted(firsts, ranks[mine], side="right") - 1
                found[mine, 0], found[mine, 1:] = ranks[mine] - firsts[i], values[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, j]) for j in range(len(names) + 1))], names=[*batch.schema.names, "within", *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ["within", *names])]))


def pack(cut: DataFrame, capacity: int = 4096, small: int = 1365, groups: int = 256) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``cut``."""
    spark = cut.sparkSession
    cols = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    cut = stored(cut.select(*cols), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    buckets = max(8, partitions(spark))

    # Large pieces: groups, configurations, slots.
    grp = grouped(counts, small, groups)
    plan = configurations([g[1] for g in grp], [g[2] for g in grp], capacity)
    slots: dict[int, list[tuple]] = defaultdict(list)  # group -> (first rank, first sequence, slot)
    taken, first = [0] * len(grp), 0
    for used, times in plan:
        for g, n in used.items():
            for k in range(n):
                slots[g].append((taken[g], first, g * capacity + k))
                taken[g] += times
        first += times
    of = [(n, g) for g, (lo, hi, _) in enumerate(grp) for n in range(lo, hi + 1)]  # at most `capacity` rows
    of = F.broadcast(spark.createDataFrame(of, "length long, grp int"))
    large = _ranked(cut.where(F.col("length") > small).join(of, "length"), "grp", ["row", "piece"], buckets)
    large = _lookup(large, "grp", slots, ["first_sequence", "slot"]).withColumn("sequence_id", F.col("first_sequence") + F.col("within"))
    order = Window.partitionBy("sequence_id").orderBy("slot")
    large = stored(large.withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*cols, "sequence_id", "offset"), "large")

    # Rooms that are left, by class and rank; small pieces by length and rank.
    fills = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    fills = stored(_ranked(fills.where("room > 0"), "room", ["sequence_id"], buckets), "rooms")
    rooms = {int(r["room"]): int(r["n"]) for r in fills.groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()}
    lay = best_fit(rooms, {n: c for n, c in counts.items() if n <= small}, capacity)
    places: dict[int, list[tuple]] = defaultdict(list)
    for length, rank, _, cls, at, offset in lay:
        places[length].append((rank, cls, at, offset))
    tiny = _ranked(cut.where(F.col("length") <= small), "length", ["row", "piece"], buckets)
    tiny = _lookup(tiny, "length", places, ["class", "class_rank", "offset"]).withColumn("class_rank", F.col("class_rank") + F.col("within"))
    opened = tiny.where(F.col("class") == capacity + 1).withColumn("sequence_id", F.col("class_rank") + F.lit(first))
    filled = tiny.where(F.col("class") <= capacity).join(fills.select(F.col("room").alias("class"), F.col("rank").alias("class_rank"), "sequence_id"), ["class", "class_rank"])
    out = [*cols, "sequence_id", "offset"]
    return large.select(out).unionByName(filled.select(out)).unionByName(opened.select(out))
