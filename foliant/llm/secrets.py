r"""Secrets: fixed patterns, and multipart credentials linked within scopes.

Three kinds (assign, access, hex) are found by pattern alone. A credential often has several parts: an access
identifier, a secret and an endpoint. Weak candidates for each part say little by themselves: a user name or mail address, a
URL, host or address, a string of mixed letters and digits. They are reported only where complementary parts stand together:
identifiers and endpoints need a secret, weak secrets need an identifier or an endpoint. The parts of a document are intervals,
joined by a sweep: two are together if they overlap, or if at most SCOPE characters and no blank line are between them. Of all parts
that end before a place the last to end is the nearest, and of all that start after it the first to start, so that looking
at these two and at overlaps finds a complement if there is one.

Patterns have no upper bounds, and run in time linear in the text.

Defined results: a null text counts as empty and has no spans; long secrets and very long texts are taken whole; repeated rows are
handled alike; a null doc_id is passed on; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread, table, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

SCOPE = 400  # characters between parts of a credential
IDENTIFIER = re.compile(r"(?ai)\b(?:user(?:name)?|login|client_?id|account|access_key_id)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9._@-]{3,}+")
IDENTIFIER_WORDS = ("user", "login", "client", "account", "access_key")
MAIL_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
URL = re.compile(r"://[^\s\"'<>]{4,}+")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
PORT = re.compile(r":[0-9]{2,5}\b")
HOST = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")
ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
BLANK = re.compile(r"\n[ \t\r]*+\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def is_opaque(s: str) -> bool:
    """Letters of both cases and digits, mixed well."""
    return any(map(str.isdigit, s)) and any(map(str.islower, s)) and any(map(str.isupper, s)) and entropy(s) >= 3.5


def _leftward(text: str, anchors: Iterator[re.Match], chars: frozenset) -> Iterator[tuple[int, re.Match]]:
    """Matches that go on to the left over some characters, though not into the one before: where they start."""
    end = 0
    for m in anchors:
        start = m.start()
        while start > end and text[start - 1] in chars:
            start -= 1
        end = m.end()
        yield start, m


def identifiers(text: str, low: str) -> Iterator[tuple[int, int]]:
    if any(w in low for w in IDENTIFIER_WORDS):
        yield from (m.span() for m in IDENTIFIER.finditer(text))
    if "@" in text:
        yield from ((a, m.end()) for a, m in _leftward(text, MAIL_HOST.finditer(text), MAIL_NAME) if a < m.start())


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    if "://" in text:
        for a, m in _leftward(text, URL.finditer(text), SCHEME):
            while a < m.start() and not text[a].isalpha():
                a += 1
            if m.start() - a >= 2:
                yield a, m.end()
    if "." in text:
        for a, m in _leftward(text, PORT.finditer(text), HOST):
            name = text[a : m.start()].lstrip(".-")
            last = name.rpartition(".")[2]
            if "." in name and len(last) >= 2 and last.isalpha():
                yield m.start() - len(name), m.end()
        yield from (m.span() for m in ADDRESS.finditer(text) if all(int(p) <= 255 for p in m[0].split(".")))


class Parts:
    """Intervals of a document's parts, for looking up whether one stands together with a given interval."""

    def __init__(self, spans: list[tuple[int, int]], walls: list[int]):
        self.spans, self.walls = sorted(spans), walls
        self.starts, self.ends = [a for a, _ in self.spans], sorted(b for _, b in self.spans)
        self.reach = list(accumulate((b for _, b in self.spans), max))  # how far those up to here extend

    def near(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)  # those before i start before b
        if i and self.reach[i - 1] > a:
            return True
        j = bisect_right(self.ends, a)
        return (j > 0 and self._open(self.ends[j - 1], a)) or (i < len(self.starts) and self._open(b, self.starts[i]))

    def _open(self, a: int, b: int) -> bool:
        return b - a <= SCOPE and bisect_left(self.walls, a) == bisect_left(self.walls, b)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all weak parts; kinds identifier, endpoint, opaque. Opaque ones overlap nothing else."""
    weak = [(a, "identifier", b) for a, b in identifiers(text, text.lower())] + [(a, "endpoint", b) for a, b in endpoints(text)]
    if not weak and not any(k == 1 for _, k, _ in base):
        return []  # then nothing can support a weak secret
    joined: list[tuple[int, int]] = []
    for a, b in sorted([(a, b) for a, _, b in base] + [(a, b) for a, _, b in weak]):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    starts = [x for x, _ in joined]

    def clear(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or joined[i - 1][1] <= a

    return weak + [(m.start(), "opaque", m.end()) for m in OPAQUE.finditer(text) if clear(m.start(), m.end()) and is_opaque(m[0])]


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of weak parts that stand together with a complement and aren't inside a base span."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    walls = [m.start() for m in BLANK.finditer(text)]
    secrets = Parts([(a, b) for a, k, b in base if k != 1] + [(a, b) for a, k, b in weak if k == "opaque"], walls)
    carriers = Parts([(a, b) for a, k, b in base if k == 1] + [(a, b) for a, k, b in weak if k != "opaque"], walls)
    spans = sorted((a, b) for a, _, b in base)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def inside(a: int, b: int) -> bool:
        i = bisect_right(starts, a)
        return i > 0 and reach[i - 1] >= b

    return sorted({(a, k, b) for a, k, b in weak if (carriers if k == "opaque" else secrets).near(a, b) and not inside(a, b)})


RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = base_spans(text)
            said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
            every = [(a, k, s) for (a, k, _), s in zip(base, said, strict=True)] + [(a, len(KINDS), f"{k}:{a}:{b}") for a, k, b in linked_spans(text, base)]
            row = {"doc_id": doc_id, "base_sha256": hashlib.sha256(",".join(said).encode()).hexdigest(), "spans": ",".join(x[2] for x in sorted(every))}
            rows.append(row | {f"n_{k}": sum(x[1] == i for x in base) for i, k in enumerate(KINDS)})
        yield pa.RecordBatch.from_pylist(rows, schema=RESULT)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return spread(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
