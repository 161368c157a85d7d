"""BPE encoding and decoding of whole texts with a public tokenizer file.

Short texts are encoded one by one inside Arrow batches. A long text is cut into parts that are encoded in parallel by
separate tasks; a tree of joins then makes one encoding of them: around each join a window is encoded anew and grows
until both sides agree with it exactly, so the result is that of encoding the whole text at once.

Two facts make this exact. White space always separates pre-tokens. And a token sequence is the BPE encoding of its
text if every neighbouring pair is the encoding of its own text, so where a window and a side share tokens at the same
place, the side's tokens beyond them stay valid.

Within a task, words seen before come from a bounded cache of two generations. The cache is only a cache: a word's ids
don't depend on its neighbours, because white space is dropped before the merges.

Defined cases: a null text counts as empty and has no ids; strings of the file's special tokens inside a text become
those tokens, as the library does by default; repeated rows are encoded each for itself; an empty table gives no rows;
all other columns of the input are kept, and a column called ``ids`` or ``decoded`` is replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_or_empty, tokenizer_path

#: Texts beyond this many code points are cut into parts of PART.
LONG, PART = 1 << 16, 1 << 15
_CACHE_WORDS = 400_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
_PLAIN_SPACE = re.compile("[ \t\n\r]+")
_LATIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")  # lower-case, composed, one letter class
_TAIL = ".,;:!?"
_MARK = re.compile(r"[.,;:!?](?<=[^\W_].)(?!\S)")  # a sign that ends a word: a pre-token of its own
_SPACE = re.compile(r"\s")


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE has for bytes: printable ones are themselves, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """word -> packed ids, of the words of this generation; a word that isn't there yet comes from the generation before
    or is encoded on the way."""

    def __init__(self, encoder: "Encoder", before: dict):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        packed = self[word] = self.before.get(word) or self.encoder.word(word)
        return packed

    def next(self) -> "_Words":
        """A new generation; words that are still in use come over from this one, which forgets the one before it."""
        self.before = {}
        return _Words(self.encoder, self)


class Encoder:
    """Whole-text encoding by words, and joins of separately encoded parts."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.symbols = _byte_symbols()
        self.cache = _Words(self, {})

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One per worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def plain(self, text: str) -> list[int]:
        """The library's own encoding of a whole text."""
        return self.tok.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> bytes:
        """Packed ids of one word, without the cache."""
        core = word.rstrip(_TAIL)
        low = core.lower()
        if not core or not _LATIN.fullmatch(low):
            return _pack(self.plain(word))
        if low != word:  # a letter run ends where these signs begin, so both parts stand for themselves
            return self.cache[low] + (self.cache[word[len(core) :]] if len(core) < len(word) else b"")
        return _pack([t.id for t in self.model.tokenize(low if low.isascii() else "".join(map(self.symbols.get, low.encode())))])

    def packed(self, text: str) -> bytes:
        """Packed ids of a whole text, equal to plain()'s."""
        if len(self.cache) > _CACHE_WORDS:
            self.cache = self.cache.next()
        return b"".join(map(self.cache.__getitem__, words_of(text)))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return unpack(self.packed(text)).tolist()

    def spans(self, text: str, at: int = 0) -> "Tokens":
        """Ids with the places of their code points; ``at`` is where the text begins."""
        e = self.tok.encode(text, add_special_tokens=False)
        where = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
        return Tokens(np.array(e.ids, dtype=np.int64), where[:, 0], where[:, 1])

    def join(self, left: "Tokens", right: "Tokens", text: str, a: int, cut: int, b: int, window: int = 64) -> "Tokens":
        """Tokens of text[a:b] from those of text[a:cut] and text[cut:b]."""
        while True:
            lo, hi = max(a, cut - window), min(b, cut + window)
            mid = self.spans(text[lo:hi], lo)
            i = (0, 0) if lo == a else mid.agree(left, lo + 1, cut, text)
            j = (len(mid.ids), len(right.ids)) if hi == b else mid.agree(right, cut + 1, hi, text)
            if i and j and i[0] <= j[0]:
                return Tokens.concat(left.part(0, i[1]), mid.part(i[0], j[0]), right.part(j[1], None))
            if lo == a and hi == b:
                return mid
            window *= 2

    def tree(self, parts: list["Tokens"], text: str, cuts: list[int]) -> "Tokens":
        """Join neighbours pairwise until one is left; cuts: the parts' borders, both ends included."""
        while len(parts) > 1:
            nxt, borders = [], [cuts[0]]
            for k in range(0, len(parts) - 1, 2):
                nxt.append(self.join(parts[k], parts[k + 1], text, cuts[k], cuts[k + 1], cuts[k + 2]))
                borders.append(cuts[k + 2])
            if len(parts) % 2:
                nxt.append(parts[-1])
                borders.append(cuts[-1])
            parts, cuts = nxt, borders
        return parts[0]


class Tokens:
    """Ids and where each begins and ends."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.ids, self.start, self.end = ids, start, end

    def part(self, i: int, j: int | None) -> "Tokens":
        return Tokens(self.ids[i:j], self.start[i:j], self.end[i:j])

    @staticmethod
    def concat(*t: "Tokens") -> "Tokens":
        return Tokens(*(np.concatenate([getattr(x, k) for x in t]) for k in ("ids", "start", "end")))

    def agree(self, other: "Tokens", lo: int, hi: int, text: str, run: int = 3) -> tuple[int, int] | None:
        """First place in [lo, hi) where both begin a token cleanly and go on alike for ``run`` tokens, or where white
        space ends; as an index into each."""
        first, last = np.searchsorted(self.start, lo), np.searchsorted(self.start, hi)
        for i in range(first, last):
            p = self.start[i]
            k = int(np.searchsorted(other.start, p))
            if k >= len(other.ids) or other.start[k] != p or (i and self.end[i - 1] > p) or (k and other.end[k - 1] > p):
                continue
            same = all(np.array_equal(x[i : i + run], y[k : k + run]) for x, y in ((self.ids, other.ids), (self.start, other.start), (self.end, other.end)))
            if same and (i + run < last or _SPACE.match(text[p - 1])) and self.end[i] < hi:
                return i, k
        return None


def words_of(text: str) -> list[str]:
    """The text's words, which are encoded apart. In texts of Latin-1 letters without special tokens case folds and signs at
    a word's end are words themselves, so that the cache holds a word once."""
    if _ODD_SPACE.search(text):
        return _PLAIN_SPACE.split(text)
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = _MARK.sub(r" \g<0>", text.lower())
        except UnicodeEncodeError:
            pass
    return text.split()


def _pack(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """Ids of a packed column value."""
    return np.frombuffer(packed, dtype="<u4")


def _add(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a column put last, in place of one of that name."""
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def encoder_of(path: str, column: str):
    """A mapInArrow function that puts the packed ids of each row's text in the column ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(column))
            yield with_column(batch, "ids", pa.array([encoder.packed(x or "") for x in texts.to_pylist()], pa.binary()))

    return run


def encode(docs: DataFrame, column: str = "text", path: str | None = None, then: tuple | None = None, long: int = LONG, part: int = PART) -> DataFrame:
    """The documents with ``ids``: their whole text's token ids, packed as little-endian unsigned 32-bit integers.

    ``then``: a mapInArrow function over these rows and its schema, run in the same pass."""
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    docs = docs.drop("ids")
    size = F.length(text_or_empty(column))
    schema = _add(docs.schema, T.StructField("ids", T.BinaryType()))
    code = encoder_of(path, column)
    follow, out = then or ((lambda batches: batches), schema)
    short = docs.where(size <= long).mapInArrow(lambda batches: follow(code(batches)), out)
    return short.unionByName(_encode_long(docs.where(size > long), column, path, part, follow, out))


def _encode_long(docs: DataFrame, column: str, path: str, part: int, follow, out: T.StructType) -> DataFrame:
    """Parts of each long text, dealt out evenly and encoded, then joined by document."""
    names = docs.columns
    keyed = docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    text = F.col(f"_row.`{column}`")
    begins = F.sequence(F.lit(0), F.length(text) - 1, F.lit(part))
    parts = keyed.select("_key", "_row", F.posexplode(begins).alias("_n", "_at"))
    parts = parts.select("_key", "_n", "_at", F.when(F.col("_n") == 0, F.col("_row")).alias("_row"), F.substring(text, F.col("_at") + 1, F.lit(part)).alias("_text"))
    parts = parts.repartition("_key", "_n")
    ints = T.ArrayType(T.LongType())
    coded = parts.mapInArrow(_encode_parts(path), T.StructType([*parts.schema.fields, *(T.StructField(n, ints) for n in ("_ids", "_start", "_end"))]))

    def whole(table: pa.Table) -> pa.Table:
        """One document's parts: as much as one cell of the input holds."""
        table = table.sort_by("_n")
        encoder = Encoder.of(path)
        texts = table["_text"].to_pylist()
        cuts = [*table["_at"].to_pylist(), table["_at"][-1].as_py() + len(texts[-1])]
        tokens = [Tokens(*(np.array(table[n][i].as_py(), dtype=np.int64) for n in ("_ids", "_start", "_end"))) for i in range(len(texts))]
        ids = encoder.tree(tokens, "".join(texts), cuts).ids
        row = table["_row"].slice(0, 1).combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        coded_row = pa.RecordBatch.from_arrays([*(row.field(n) for n in names), pa.array([_pack(ids)], pa.binary())], names=[*names, "ids"])
        return pa.Table.from_batches(list(follow(iter([coded_row]))))

    return coded.groupBy("_key").applyInArrow(whole, out)


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            at, texts = batch.column("_at").to_pylist(), batch.column("_text").to_pylist()
            for name, get in (("_ids", "ids"), ("_start", "start"), ("_end", "end")):
                if name == "_ids":
                    coded = [encoder.spans(x, a) for a, x in zip(at, texts, strict=True)]
                batch = with_column(batch, name, pa.array([getattr(c, get) for c in coded], pa.list_(pa.int64())))
            yield batch

    return run


def decoder_of(path: str, drop: tuple[str, ...] = ()):
    """A mapInArrow function that puts the text of each row's ``ids`` in the column ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Encoder.of(path).tok
        for batch in batches:
            packed = batch.column(batch.schema.names.index("ids"))
            texts = [tok.decode(unpack(x.as_py() or b"").tolist(), skip_special_tokens=False) for x in packed]
            batch = batch.select([n for n in batch.schema.names if n not in drop])
            yield with_column(batch, "decoded", pa.array(texts, pa.string()))

    return run


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with ``decoded``: the library's text of their packed ``ids``, special tokens kept. Null ids: empty."""
    return coded.mapInArrow(decoder_of(path or tokenizer_path()), _add(coded.schema, T.StructField("decoded", T.StringType())))


def round_trip(docs: DataFrame, column: str = "text", path: str | None = None) -> DataFrame:
    """The documents with ``ids`` and ``decoded`` and without their text, in one pass."""
    path = path or tokenizer_path()
    docs = docs.drop("ids", "decoded")
    rest = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*rest, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return encode(docs, column, path, then=(decoder_of(path, drop=(column,)), schema))
