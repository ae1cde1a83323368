"""Secret scans: three fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of at least ``WINDOW`` base64, URL-safe or hexadecimal characters. Every
window in it is judged by the narrowest character class that holds it; the counts behind its
Shannon entropy are updated as the window moves. Windows at or over their class's threshold
are joined to spans, unless a pattern span holds them. Placeholder words and counting sequences
cut a candidate: what lies on each side of one is judged alone, against the allow-list of shapes
too. A span that reaches such a word goes on over it as far as letters and digits do.

Defined results: a null text is empty; a text without spans gives zero counts, an empty span
list and the digest of the empty string; repeated rows are scanned one by one; an empty table
gives no rows; other columns are passed on or ignored as the caller asks.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dwellpath.llm.spark import rested
from dwellpath.llm.text import utf8

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

WINDOW = 20
#: Fixed values: (class, its characters, lowest entropy in bits of a window of 20).
CLASSES = (
    ("hex", "0123456789abcdef", 3.0),
    ("HEX", "0123456789ABCDEF", 3.0),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.5),
    ("lower", "abcdefghijklmnopqrstuvwxyz0123456789", 3.6),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
#: Shapes that are never a secret, however random they look.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        rb"[A-Za-z]+",
        rb"[0-9_=+/-]+",
        rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        rb"[A-Za-z]+(?:[-_/=+][A-Za-z]+)+[0-9]{0,4}",
    )
)


def _counted(chars: str) -> str:
    """A pattern of the first three characters or more, in order."""
    return chars[:3] + "".join(f"(?:{c}" for c in chars[3:]) + ")?" * len(chars[3:])


#: Words of placeholders, and the sequence a stretch can begin with.
WORDS = re.compile(rb"(?i:example|sample|placeholder|changeme|dummy|x{4,})")
COUNTED = re.compile(f"(?=0123456789|abcdefghij)(?:{'|'.join(map(_counted, ('0123456789', 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')))})+".encode())
_JOINTS, _SOLID = b"-_/=+", re.compile(rb"[A-Za-z0-9]*")


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[list(chars.encode())] = True
    return m


_HEX, _CANDIDATE = _mask(CLASSES[0][1]), _mask(CLASSES[-1][1])
_MEMBER = [_mask(c[1]) for c in CLASSES]
#: Windows of a long candidate that are looked at together.
_AT_ONCE = 1 << 14
_PLOGP = [0.0] + [-(k / WINDOW) * math.log2(k / WINDOW) for k in range(1, WINDOW + 1)]


def runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` marked bytes that stay within one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[offsets] = True
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end[:-1] &= ~mask[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = e - s >= least
    return s[long], e[long]


def stretches(candidate: bytes) -> Iterator[tuple[int, int]]:
    """What placeholder words and leading sequences leave of a candidate, where a window fits."""
    at = 0
    for end, after in [*(m.span() for m in WORDS.finditer(candidate)), (len(candidate), 0)]:
        first = at
        while first < end and candidate[first] in _JOINTS and at:
            first += 1
        if m := COUNTED.match(candidate, first, end):
            at = m.end()
        if end - at >= WINDOW:
            yield at, end
        at = after


def entropy_spans(candidate: bytes) -> list[tuple[int, int]]:
    """Joined high windows of a candidate's stretches."""
    if any(p.fullmatch(candidate) for p in ALLOWED):
        return []
    parts = list(stretches(candidate))
    if parts == [(0, len(candidate))]:
        return high_windows(candidate)
    found: list[tuple[int, int]] = []
    for lo, hi in parts:
        part = candidate[lo:hi]
        if any(p.fullmatch(x) for p in ALLOWED for x in (part, part.strip(_JOINTS))):
            continue
        for a, b in high_windows(part):
            a, b = lo + a, lo + b
            if b == hi and part[-1] not in _JOINTS:  # the rest of a blob beside a word that came up in it by chance
                b = _SOLID.match(candidate, b).end()
            if a == lo and part[0] not in _JOINTS:
                a -= _SOLID.match(candidate[:a][::-1]).end()
            if found and found[-1][1] >= a:
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
    return found


def high_windows(candidate: bytes) -> list[tuple[int, int]]:
    """Joined windows whose entropy reaches the threshold of their class."""
    found: list[tuple[int, int]] = []
    for lo in range(0, len(candidate) - WINDOW + 1, _AT_ONCE):
        for a, b in _high_windows(candidate[lo : lo + _AT_ONCE + WINDOW - 1]):
            if found and found[-1][1] >= lo + a:
                found[-1] = (found[-1][0], lo + b)
            else:
                found.append((lo + a, lo + b))
    return found


def _high_windows(candidate: bytes) -> list[tuple[int, int]]:
    n = len(candidate)
    outside = [[not m[c] for c in candidate] for m in _MEMBER]
    out = [sum(o[:WINDOW]) for o in outside]
    counts = [0] * 256
    for c in candidate[:WINDOW]:
        counts[c] += 1
    entropy = sum(_PLOGP[k] for k in counts if k)
    found: list[tuple[int, int]] = []
    for a in range(n - WINDOW + 1):
        if a:
            gone, come = candidate[a - 1], candidate[a + WINDOW - 1]
            for c, d in ((gone, -1), (come, 1)):
                entropy -= _PLOGP[counts[c]]
                counts[c] += d
                entropy += _PLOGP[counts[c]]
            for k, o in enumerate(outside):
                out[k] += o[a + WINDOW - 1] - o[a - 1]
        least = next((CLASSES[k][2] for k in range(len(CLASSES)) if not out[k]), math.inf)
        if entropy >= least - 1e-9:
            if found and found[-1][1] >= a:
                found[-1] = (found[-1][0], a + WINDOW)
            else:
                found.append((a, a + WINDOW))
    return found


def scan_batch(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) of each text in code points, by start, then kind."""
    raw, off = utf8(texts)
    data = raw.tobytes()
    base: list[list[tuple[int, int]]] = [[], [], []]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        base[0] += [m.span() for m in ASSIGN.finditer(data, a, b) if m.end(1) - m.start(1) >= MIN_ASSIGN]
        base[1] += [m.span() for m in ACCESS.finditer(data, a, b) if m.end() - m.start() >= MIN_ACCESS]
    base[2] = list(zip(*(x.tolist() for x in runs(_HEX[raw], off, MIN_HEX)), strict=True))
    starts = [[a for a, _ in spans] for spans in base]

    def held(a: int, b: int) -> bool:
        """Whether a span of a pattern holds this one: of a kind's spans, which don't overlap, only the last begun can."""
        at = [bisect_right(s, a) - 1 for s in starts]
        return any(k >= 0 and base[kind][k][1] >= b for kind, k in enumerate(at))

    found = [(kind, a, b) for kind in range(3) for a, b in base[kind]]
    for s, e in zip(*(x.tolist() for x in runs(_CANDIDATE[raw], off, WINDOW)), strict=True):
        found += [(3, s + a, s + b) for a, b in entropy_spans(data[s:e]) if not held(s + a, s + b)]
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    for (kind, a, b), i in zip(found, (np.searchsorted(off, [x[1] for x in found], side="right") - 1).tolist(), strict=True):
        spans[i].append((kind, a, b))
    for i, own in enumerate(spans):
        if own:
            start = int(off[i])
            here = np.cumsum((raw[start : off[i + 1]] & 0xC0) != 0x80)
            at = lambda x: int(here[x - start - 1]) if x > start else 0  # noqa: E731, B023
            spans[i] = sorted(((k, at(a), at(b)) for k, a, b in own), key=lambda x: (x[1], x[0], x[2]))
    return spans


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            spans = scan_batch(part.column(1))
            count = lambda k: pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [part.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(write([x for x in s if x[0] < 3]).encode()).hexdigest() for s in spans]), pa.array([write(s) for s in spans]), count(3)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )


def scan(documents: DataFrame) -> DataFrame:
    """Counts, digest and spans of each text; spans are ``kind:start:end`` joined by commas."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return documents.select("doc_id", "text").mapInArrow(_digest, schema)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch covered by spans replaced by ``<kind>`` of its first span."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with spans in ``text`` replaced; ``n_chars``, where present, follows the text."""
    names = documents.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                spans = scan_batch(part.column(at))
                cols = list(part.columns)
                if any(spans):
                    texts = [redact_text(t, s) if s else t for t, s in zip(part.column(at).to_pylist(), spans, strict=True)]
                    cols[at] = pa.array(texts, cols[at].type)
                    if chars is not None:
                        cols[chars] = pa.array([len(t) if s else c for t, s, c in zip(texts, spans, cols[chars].to_pylist(), strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return documents.mapInArrow(rested(run), documents.schema)
