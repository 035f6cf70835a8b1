"""Secret scans with linking of credentials that come in parts.

Three strict kinds are reported wherever they stand. Parts that mean little alone (a user or client name, a string that looks random, an
endpoint) are weak: each has an interval of characters around it as its scope, intervals of complementary parts are joined, and a weak
part is reported only where such a join finds it a partner.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.store import small_batches

#: Fixed patterns of the strict kinds, each with its least length and the group that the length is of.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "material", "endpoint")
STRICT = KINDS[:3]

#: Weak kinds: who asks, what proves it, where it is used.
IDENTIFIER = re.compile(r"""(?ai:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""")
MATERIAL = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ADDRESS = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+""")
ENDPOINT = re.compile(r"""(?ai:\b(?:host|server|endpoint))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]{2,5})?""")
ENTROPY = 3.5
#: Code points around a part in which its complement must begin or end.
SCOPE = 200
#: Which kinds complete a weak one; strict ones count by what they are.
ROLE = {"assign": "proof", "material": "proof", "hex": "proof", "access": "name", "identifier": "name", "endpoint": "place"}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _random_looking(s: str) -> bool:
    n = len(s)
    mixed = any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)
    return mixed and -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= ENTROPY


def strict_spans(text: str) -> list[Span]:
    """Leftmost matches of each strict kind that do not overlap, without those that are too short."""
    found = []
    if ":" in text or "=" in text:
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def weak_spans(text: str, strict: list[Span]) -> list[Span]:
    """Weak parts that no strict span overlaps."""
    found = []
    if ":" in text or "=" in text:
        found += [Span("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
        found += [Span("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if "://" in text:
        found += [Span("endpoint", *m.span()) for m in ADDRESS.finditer(text)]
    found += [Span("material", *m.span()) for m in MATERIAL.finditer(text) if _random_looking(m[0])]
    free = uncovered(strict)
    return [s for s in found if free(s)]


def uncovered(strict: list[Span]) -> Callable[[Span], bool]:
    """Whether a span overlaps no strict one. Strict spans that overlap or touch are one cover, so only the last that begins before a span's end is asked."""
    covers: list[list[int]] = []
    for a, b in sorted((s.start, s.end) for s in strict):
        if covers and a <= covers[-1][1]:
            covers[-1][1] = max(covers[-1][1], b)
        else:
            covers.append([a, b])

    def free(s: Span) -> bool:
        at = bisect_left(covers, [s.end])
        return not at or covers[at - 1][1] <= s.start

    return free


def linked(strict: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak spans whose scope meets a part of another role: one sweep over all parts by where they begin.

    A place alone proves nothing: it is reported with a proof or a name, a name with a proof or a place, a proof with a name or a place.
    """
    parts = sorted([*strict, *weak], key=lambda s: s.start)
    if not weak or len({ROLE[s.kind] for s in parts}) < 2:
        return []
    keep: set[Span] = set()
    # The furthest end of each role that began before, and the nearest start of those that begin after.
    for forward, ordered, gap in ((True, parts, lambda s, edge: s.start - edge), (False, parts[::-1], lambda s, edge: edge - s.end)):
        edge: dict[str, int] = {}
        for s in ordered:
            role = ROLE[s.kind]
            if s.kind not in STRICT and any(r != role and gap(s, e) <= scope for r, e in edge.items()):
                keep.add(s)
            mine = s.end if forward else s.start
            edge[role] = max(edge.get(role, mine), mine) if forward else min(edge.get(role, mine), mine)
    return [s for s in weak if s in keep]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end)))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("weak", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column(1):
            text = text.as_py() or ""
            strict = strict_spans(text)
            weak = linked(strict, weak_spans(text, strict))
            both = sorted([*strict, *weak], key=lambda s: (s.start, KINDS.index(s.kind), s.end))
            spans.append([{"kind": s.kind, "start": s.start, "end": s.end, "weak": s.kind not in STRICT} for s in both])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``spans``, array<struct<kind, start, end, weak>> by start and kind, in code points, end exclusive.

    Whole texts are searched; null and empty ones have no spans. Repeated rows are searched each by itself. Other columns are not read.
    """
    narrow = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = narrow.mapInArrow(_scan, f"id {narrow.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,weak:boolean>>")
    return found.select(F.col("id").alias(id_col), "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``secrets`` as counts of the strict kinds, their SHA-256 and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    strict = F.filter("spans", lambda s: ~s["weak"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(id_col, *(count(k) for k in STRICT), F.sha2(text(strict), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
