"""Secret scans: fixed kinds, and a token-efficiency test for random strings.

Three fixed kinds (assignments, access keys, long hexadecimal runs) are found by pattern. The token-efficiency test adds
spans of kind ``token``: a run of key characters that a byte-level vocabulary, made from ordinary text, can only spell
out in short tokens (few characters per token) is a random string, whether it has digits or not. Known digests
(hexadecimal of the usual lengths), UUIDs and chains of readable words and numbers exclude the part they match and no more:
a run with none of them is judged as a whole, else what lies between them is, and where a whole is not random its parts
between / + _ - = are judged one by one. Letters of one case (but for the first) are judged by a stricter ratio, as long
words of languages the vocabulary has seen little of come near the other.

Spans are in code points, end exclusive. Defined cases: a null text counts as empty and has no spans; repeated rows are
scanned each for itself; an empty table gives no rows; other columns are kept, ``spans`` is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_column
from .common import small_batches, tokenizer_path, unused

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs of hexadecimal digits; only those of 24 and more are asked for, so only they are matched.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs of key characters that can hold a random string.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Parts of a run that are no secret: digests, UUIDs, and chains of readable words and numbers.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:0x)?(?:[0-9a-fA-F]{128}|[0-9a-fA-F]{96}|[0-9a-fA-F]{64}|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha(?:1|224|256|384|512)-[A-Za-z0-9+/]{27,86}={0,2}"
    r"|(?:[A-Z]?[a-z]{3,}|[0-9]+)(?:[/_=-]+(?:[A-Z]?[a-z]{3,}|[0-9]+))+|[A-Z]{3,}(?:_+[A-Z]{2,})+)(?![A-Za-z0-9])"
)
_PART = re.compile(r"[A-Za-z0-9]+")
_LONG = re.compile(r"[A-Za-z0-9]{3}")
_WORD = re.compile(r"[A-Za-z]?(?:[a-z]+|[A-Z]+)")
#: The share of the ratio that letters of one case are held to.
WORDS = 0.87

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Scanner:
    """The patterns and the vocabulary; one per worker."""

    _made: dict[tuple, "Scanner"] = {}

    def __init__(self, path: str, ratio: float, least: int):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.enc = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ratio, self.least = ratio, least

    @classmethod
    def of(cls, *key) -> "Scanner":
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def efficiency(self, run: str) -> float:
        """Characters per token."""
        return len(run) / max(1, len(self.enc.encode_ordinary(run)))

    def random(self, run: str) -> bool:
        """Whether a run without known parts is a random string."""
        letters = sum(c.isalpha() for c in run)
        if len(run) < self.least or letters < 4 or _KNOWN.search(run) or not _LONG.search(run):
            return False
        return self.efficiency(run) <= (self.ratio * WORDS if _WORD.fullmatch(run) else self.ratio)

    def parts(self, run: str) -> Iterator[tuple[int, int]]:
        """Where the random strings of a run are: what lies between its known parts, as a whole or else by part."""
        at = 0
        for a, b in [*(m.span() for m in _KNOWN.finditer(run)), (len(run), len(run))]:
            if a - at >= self.least:
                if self.random(run[at:a]):
                    yield at, a
                else:
                    yield from (m.span() for m in _PART.finditer(run, at, a) if m.end() - m.start() < a - at and self.random(m[0]))
            at = b

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order of start, then kind."""
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base, at, reach = sorted(out), 0, -1
        for m in RUN.finditer(text):
            a = m.start()
            for i, j in self.parts(m[0]):  # in order of start: base spans before a part are passed once
                while at < len(base) and base[at][0] < a + j:
                    reach = max(reach, base[at][2])
                    at += 1
                if reach <= a + i:
                    out.append((a + i, 3, a + j))
        return sorted(out)


def scan(docs: DataFrame, column: str = "text", path: str | None = None, ratio: float = 2.2, least: int = 16, spans: str = "spans") -> DataFrame:
    """The documents with ``spans`` (or the name given): kind, start and end of every secret in the whole text."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)
    docs = docs.drop(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(path, ratio, least)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(batch.schema.names.index(column)).to_pylist()
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(x)] if x else [] for x in texts]
            yield with_column(batch, spans, pa.array(found, kind))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(spans, SPAN)]))


def listed(spans: str, base_only: bool = False):
    """kind:start:end of every span, or of the fixed kinds, comma-joined."""
    col = F.filter(spans, lambda s: s["kind"] != "token") if base_only else F.col(spans)
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, column: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """The documents with every span of their text replaced by ``mark`` (overlapping spans by one); null stays null. All
    columns are kept, one called ``spans`` too."""
    columns, spans = docs.columns, unused("spans", docs.columns)
    scanned = scan(docs, column, spans=spans, **options)

    def clean(text: str, spans) -> str:
        out, at = [], 0
        for s in spans:
            a, b = s["start"], s["end"]
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.names.index(column)
            texts = [clean(x, s) if x and s else x for x, s in zip(batch.column(i).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == i else batch.column(j) for j in range(batch.num_columns - 1)], names=batch.schema.names[:-1])

    return scanned.mapInArrow(run, docs.schema)
