"""Personal data: fixed patterns, and candidates of loose patterns that boosted trees judge.

Four base patterns (email, ip, card, phone) are found as they stand. Generators of high recall then
propose further spans, which may overlap: addresses written with "(at)", "[at]", "at" and "dot", and
stretches of 7 to 19 digits with any of the usual marks between them, as a phone number or as a card
number. Trees judge each proposal by its format and its context, and a threshold for each kind,
taken from calibrated probabilities of rows that the trees haven't seen, selects. Of selected spans
that overlap the likeliest stays; a proposal that overlaps a base span is never made.

The trees learn from the corpus itself. Positive: base spans where they stand, rewritten to forms
that the patterns don't catch. Negative: proposals in the texts, and the same places with dates,
sums, versions, serial numbers and the like. In half of the rewritten rows a word that goes with
the kind (or against it) is put before the span. All rows of all texts are learned from: they stay where
they are, and the driver gets sums by node, feature and bin for each level of a tree, and how many rows held out
have which score. Equal rows are one with a number, and a kind and label that has very many weighs less a row.

Defined results: a null text is empty; a text without spans has zero counts, an empty span list and
the digest of the empty string; without base spans in the whole table there is nothing to learn
from, and base spans are all; repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.llm.boosting import BINS, Trees, bin_cuts, calibrate, codes, grow, sigmoid, sums, threshold
from dwellpath.llm.spark import rested, stored
from dwellpath.llm.text import slices, utf8

KINDS = ("email", "ip", "card", "phone", "likely_email", "likely_card", "likely_phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The kind of a proposal less the kind of the base pattern of the same thing.
_LIKELY = {EMAIL: 4, CARD: 5, PHONE: 6}
#: What the rows of a kind and label weigh together at most, so that none outweighs the others; one row in so many is held out for calibration.
WEIGHT, HELD = 2500, 4
#: Scores are in steps of one so many-th, so that all scores of the rows held out fit a table of bounded size.
STEPS = 1024
#: Up to so many different rows the driver adds up the same sums itself, as a job for each level of a tree would take longer.
AT_DRIVER = 1 << 14
#: The share of selected spans of held-out rows that must be true.
PRECISION = 0.98

#: Proposals whose features a task holds at a time, however many a text has.
AT_ONCE = 1 << 13

#: The base patterns, with possessive repeats where a shorter run could never match.
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IPS = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARDS = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONES = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The generators: a chain of digits, the sign between the parts of an address, and what can follow it.
CHAIN = re.compile(rb"[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9])++")
AT = re.compile(rb"(?:@|\x20?[(\[][aA][tT][)\]]\x20?|\x20[aA][tT]\x20)")
REST = re.compile(rb"[A-Za-z0-9_-]{1,63}(?:(?:\.|\x20?[(\[][dD][oO][tT][)\]]\x20?|\x20[dD][oO][tT]\x20)[A-Za-z0-9_-]{1,63}){1,4}")
DOT = re.compile(rb"\.|\x20?[(\[][dD][oO][tT][)\]]\x20?|\x20[dD][oO][tT]\x20")
MIN_DIGITS, MAX_DIGITS, MAX_PIECES = 7, 19, 6
_SIGNIFICANT = re.compile(rb"[0-9@]")
_NEAR = 40

#: Words before a span that go with a kind, and words that go with other numbers.
CUES = (
    ("email", "e-mail", "mail", "contact", "write", "courriel", "correo", "schreib", "adresse", "reach"),
    ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "cvv"),
    ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "whatsapp"),
    ("version", "isbn", "order", "invoice", "page", "total", "serial", "date", "ref", "sku", "doi", "article", "build"),
)
_CUES = tuple(re.compile("|".join(rf"\b{w}" for w in words).encode(), re.IGNORECASE) for words in CUES)
_CLASSES = {**dict.fromkeys(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.0), **dict.fromkeys(b"0123456789_", 2.0), **dict.fromkeys(b" \t\n\r,;", 0.0), **dict.fromkeys(b"=\"'`/\\#$&%", 3.0)}
FEATURES = (
    "kind", "bytes", "digits", "groups", "first_group", "last_group", "longest_group", "shortest_group", "spaces", "hyphens", "dots", "brackets", "slashes", "plus", "luhn", "first_digit", "years", "distinct",
    "sign", "labels", "last_label", "local_bytes", "local_digits", "word_dots", "left_class", "right_class", "cue_email", "cue_card", "cue_phone", "cue_other", "others", "line_start",
)


def luhn(digits: bytes) -> bool:
    odd = digits[-1::-2]
    return (sum(odd) - 48 * len(odd) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[d - 48] for d in digits[-2::-2])) % 10 == 0


def _digits(b: bytes) -> bytes:
    return bytes(c for c in b if 48 <= c <= 57)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the base patterns' matches, kind by kind."""
    if not _SIGNIFICANT.search(data):
        return []
    found, free = [], 0
    at = data.find(b"@")
    while at >= 0:
        # the leftmost match begins where the run of characters before the sign does
        start = at
        while start > free and data[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(data, at + 1) if start < at else None
        if m:
            found.append((EMAIL, start, m.end()))
        free = m.end() if m else at + 1
        at = data.find(b"@", free)
    for m in IPS.finditer(data):
        if all(int(p.lstrip(b"0")[:4] or b"0") <= 255 for p in m.groups()):
            found.append((IP, *m.span()))
    for m in CARDS.finditer(data):
        if 12 <= m.end() - m.start() <= 2 * 19:
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((CARD, *m.span()))
    for m in PHONES.finditer(data):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((PHONE, *m.span()))
    return found


def proposals(data: bytes, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what the generators propose outside the taken spans; proposals may overlap."""
    spans = sorted((a, b) for _, a, b in taken)
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def free(a: int, b: int) -> bool:
        k = bisect_right(starts, b - 1) - 1
        return k < 0 or merged[k][1] <= a

    for m in CHAIN.finditer(data):
        if m.end() - m.start() < MIN_DIGITS:
            continue
        pieces, at = [], m.start()
        for piece in m.group().split(b" "):
            if piece:
                pieces.append((at, at + len(piece), len(_digits(piece))))
            at += len(piece) + 1
        for i, (a, _, _) in enumerate(pieces):
            n = 0
            for _, b, d in pieces[i : i + MAX_PIECES]:
                n += d
                if n > MAX_DIGITS:
                    break
                if n >= MIN_DIGITS and free(a, b):
                    if n <= 15:
                        yield PHONE, a, b
                    if n >= 12:
                        yield CARD, a, b
    for m in AT.finditer(data):
        start = m.start()
        low = max(0, start - 64)
        while start > low and data[start - 1] in LOCAL:
            start -= 1
        rest = REST.match(data, m.end()) if start < m.start() else None
        if rest:
            ends = [d.start() for d in DOT.finditer(rest.group())][1:]
            yield from ((EMAIL, start, m.end() + e) for e in (*ends, len(rest.group())) if free(start, m.end() + e))


def describe(data: bytes, kind: int, a: int, b: int, others: int) -> list[float]:
    """The features of a span, in the order of FEATURES; ``others``: base spans in the text."""
    span = data[a:b]
    groups = re.findall(rb"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    digits = b"".join(groups)
    sign = AT.search(span) if kind == EMAIL else None
    tail = span[sign.end() :] if sign else b""
    labels = DOT.split(tail) if sign else []
    local = span[: sign.start()] if sign else b""
    before = data[max(0, a - _NEAR) : a]
    side = lambda k: _CLASSES.get(data[k], 4.0 if data[k] < 128 else 1.0) if 0 <= k < len(data) else 0.0
    return [
        kind, b - a, len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), span.count(b" "), span.count(b"-"), span.count(b"."), span.count(b"("), span.count(b"/"), float(span[:2].count(b"+")),
        float(bool(digits) and luhn(digits)), digits[0] - 48 if digits else -1, sum(len(g) == 4 and g[:2] in (b"19", b"20") for g in groups), len(set(digits)),
        (1.0 if sign.group() == b"@" else 2.0 if sign.group().strip()[:1] in b"([" else 3.0) if sign else 0.0, len(labels), len(labels[-1]) if labels else 0, len(local), len(_digits(local)),
        float(len(labels) - 1 - tail.count(b".")) if labels else 0.0, side(a - 1), side(b), *[float(bool(c.search(before))) for c in _CUES], min(others, 5), float(a == 0 or data[a - 1] == 10),
    ]


# ------------------------------------------------------------------ rows to learn from

def _grouped(digits: bytes, sizes: tuple[int, ...], mark: bytes) -> bytes:
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return mark.join(p for p in (*parts, digits[at:]) if p)


def rewritten(kind: int, span: bytes, h: int) -> list[tuple[bytes, bool]]:
    """(text, whether it is personal data) of what to put in a base span's place: another form of it, and what only looks like it."""
    pick = lambda of, turn: of[h // turn % len(of)]
    if kind == EMAIL:
        local, domain = span.split(b"@", 1)
        at, dot = pick(((b" at ", b" dot "), (b" (at) ", b" (dot) "), (b"[at]", b"[dot]"), (b" [at] ", b" [dot] "), (b"(at)", b"."), (b" at ", b"."), (b" (at) ", b".")), 1)
        name = re.sub(rb"[^A-Za-z._-]", b"", local).strip(b"._-") if pick((True, False), 7) else local
        labels = domain.split(b".")
        labels = labels[-2:] if pick((True, False), 14) else labels
        labels = [*labels[:-1], pick((labels[-1], b"org", b"net", b"de", b"fr", b"es", b"co"), 28)]
        word, sentence = re.sub(rb"[^a-z]", b"", local.lower())[:8] or b"was", re.sub(rb"[^a-z]", b"", domain.lower())
        aside = word + pick((b" at ", b" at ", b"@"), 3) + (sentence[:5] or b"home") + pick((b".", b". "), 5) + (sentence[5:9] or b"then").capitalize()
        return [((name or b"info") + at + dot.join(labels), True), (aside, False)]
    d = _digits(span)
    if kind == CARD:
        wrong = d[:-1] + bytes([48 + (d[-1] - 48 + 1 + h % 9) % 10])
        decoys = (_grouped(wrong, (4, 4, 4), pick((b"", b".", b"-", b" "), 4)), _grouped(wrong, (3, 3, 3, 3), b" "), b"978-" + _grouped(wrong[:10], (1, 2, 6), b"-"), wrong + d[:3])
        return [(_grouped(d, (4, 4, 4), pick((b".", b"/", b" - ", b". "), 1)), True), *((x, False) for x in decoys)]
    if kind == PHONE:
        n, year, month, day = d[-10:], str(1900 + h % 130).encode(), b"%02d" % (1 + h % 12), b"%02d" % (1 + h // 12 % 28)
        own = (
            _grouped(n, (3, 3), b"-"), _grouped(n, (3, 3), b"."), b"(" + n[:3] + b") " + _grouped(n[3:], (3,), b"-"), _grouped(n, (3, 3), b" "), b"00" + _grouped(d, (2, 2, 4), b" "),
            b"0" + _grouped(n, (3,), b"/"), b"0" + _grouped(n[1:], (1, 2, 2, 2), b" "), b"00" + _grouped(d, (2, 2), b" "), b"(0" + n[:3] + b") " + n[3:], b"1-" + _grouped(n, (3, 3), b"-"),
        )
        decoys = (
            b"-".join((year, month, day)), b".".join((day, month, year)), b"/".join((month, day, year)), year + month + day, b"%s-%s" % (year, year), b"3." + n, _grouped(b"1" + n[:9], (1, 3, 3), b" "), _grouped(n[:9], (3, 3), b" "),
            b"10.0." + n[:5] + b"." + n[5:9], n[: 7 + h % 4], d + n[:4], n[:2] + b"/" + n[2:9], _grouped(n, (2, 2, 2, 1), b" "), b"978-" + _grouped(n, (1, 2, 6), b"-"), _grouped(n + d, (1,) * 14, b" "), n[:4] + b" " + n[4:8],
        )
        return [(pick(own, 1), True), *((decoys[h // turn % len(decoys)], False) for turn in (10, 160, 2560))]
    return []


def examples(data: bytes) -> Iterator[tuple[int, int, int, list[float]]]:
    """(kind, label, hash, features) of the rows that a text gives: its proposals, and those around what is put in place of its base spans."""
    taken = base_spans(data)
    for kind, a, b in proposals(data, taken):
        yield kind, 0, zlib.crc32(data[max(0, a - _NEAR) : b + _NEAR]), describe(data, kind, a, b, len(taken))
    for kind, a, b in taken:
        left, right = data[max(0, a - 2 * _NEAR) : a], data[b : b + _NEAR]
        h = zlib.crc32(left[-_NEAR:] + data[a:b] + right)
        for text, true in rewritten(kind, data[a:b], h):
            turn = zlib.crc32(text, h)
            words = CUES[{EMAIL: 0, CARD: 1, PHONE: 2}[kind]] if true == (turn % 8 != 1) else CUES[3]
            cue = words[turn // 16 % len(words)].encode() + (b": ", b" ")[turn // 8 % 2] if turn % 2 else b""
            start, around = len(left) + len(cue), left + cue + text + right
            for k, (as_kind, x, y) in enumerate(proposals(around, [])):
                if x < start + len(text) and y > start:
                    label = int(true and as_kind == kind and (x, y) == (start, start + len(text)))
                    yield as_kind, label, turn ^ k, describe(around, as_kind, x, y, len(taken) - 1)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch.column(0))
        for lo, hi in slices(off):
            data = raw[off[lo] : off[hi]].tobytes()
            rows = (x for a, b in zip((off[lo:hi] - off[lo]).tolist(), (off[lo + 1 : hi + 1] - off[lo]).tolist(), strict=True) for x in examples(data[a:b]))
            while some := list(islice(rows, AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32())))], names=["kind", "label", "h", "x"])


@dataclass
class Model:
    """Trees over all kinds, with calibration and threshold for each."""

    trees: Trees
    lines: dict[int, tuple[float, float]]
    limits: dict[int, float]

    def chances(self, kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of proposals, less than nothing below their kind's threshold."""
        z = np.rint(self.trees.raw(x) * STEPS) / STEPS
        out = np.full(len(z), -1.0)
        for kind, (a, b) in self.lines.items():
            own = kinds == kind
            p = sigmoid(a * z[own] + b)
            out[own] = np.where(p >= self.limits[kind], p, -1.0)
        return out


def training_rows(documents: DataFrame) -> DataFrame:
    """(kind, label, held, x, n): all rows to learn from, equal ones together with their number ``n``; ``held`` ones are for calibration."""
    rows = documents.filter("text is not null").select("text").mapInArrow(rested(_examples), "kind int, label int, h long, x array<float>")
    # a copy of a span with its surroundings counts once, and lies on one side
    rows = rows.groupBy("kind", "label", "h", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("held", F.pmod(F.xxhash64("h"), F.lit(HELD)) == 0)
    return stored(rows.groupBy("kind", "label", "held", "x").agg(F.count(F.lit(1)).alias("n")))


def _columns(batch: pa.RecordBatch, shares: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, features, labels and weights of training rows (kind, label, x, n)."""
    kind, label, n = (np.asarray(batch.column(k)) for k in (0, 1, 3))
    x = np.asarray(batch.column(2).flatten()).reshape(len(kind), len(FEATURES)).astype(np.float64)
    return kind, x, label.astype(np.float64), n * np.array([shares[k] for k in zip(kind.tolist(), label.tolist(), strict=True)])


def _summed(rows: DataFrame, cuts: list[np.ndarray], shares: dict[tuple[int, int], float], trees: Trees, feature: np.ndarray, limit: np.ndarray, level: int) -> np.ndarray:
    """The sums of a level's nodes over all rows: at most 2 ** level times features times bins come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x, y, w = _columns(batch, shares)
            own = sums(codes(x, cuts), x, y, w, trees, feature, limit, level)
            total = own if total is None else total + own
        if total is not None:
            flat = total.reshape(2, -1)
            some = np.flatnonzero(flat.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[0, some]), pa.array(flat[1, some])], names=["cell", "g", "h"])

    found = rows.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((2, 2**level * len(cuts) * BINS), dtype=np.int64)
    out[:, found["cell"].to_numpy()] = found[["g", "h"]].to_numpy().T
    return out.reshape(2, 2**level, len(cuts), BINS)


def _scores(rows: DataFrame, shares: dict[tuple[int, int], float], trees: Trees) -> DataFrame:
    """(kind, label, z, n): how many rows have a score, in steps of one ``STEPS``-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, _, _ = _columns(batch, shares)
            z = pa.array(np.rint(trees.raw(x) * STEPS).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z, batch.column(3)], names=["kind", "label", "z", "n"])

    return rows.mapInArrow(run, "kind int, label int, z long, n long").groupBy("kind", "label", "z").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame) -> Model | None:
    """Learn from all of ``documents``; None where no base span is found or a label is missing."""
    rows = training_rows(documents)
    found = rows.groupBy("kind", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    counts = {(r["kind"], r["label"]): r["n"] for r in found}
    if len({label for _, label in counts}) < 2:
        return None
    # no row is left out: where a kind and label has more, each weighs less
    shares = {k: min(1.0, WEIGHT / n) for k, n in counts.items()}
    weight = F.create_map(*[F.lit(v) for (kind, label), s in shares.items() for v in (2 * kind + label, s)])[F.col("kind") * 2 + F.col("label")]
    learned = rows.filter("not held").select("kind", "label", "x", "n")
    # features are small numbers, so a feature has some hundred values at most, however many rows
    valued = learned.select(F.posexplode("x").alias("f", "v"), "label", (weight * F.col("n")).alias("w")).groupBy("f", "v", "label").agg(F.sum("w").alias("w")).orderBy("f", "v", "label").toPandas()
    if not len(valued):
        return None
    first = valued[valued["f"] == 0]
    share = round(float(first.loc[first["label"] == 1, "w"].sum() / first["w"].sum()), 6)
    cuts = []
    for f in range(len(FEATURES)):
        v = valued[valued["f"] == f].groupby("v")["w"].sum().round(6)  # sums of fractions differ in their last digits by the order of rows
        cuts.append(bin_cuts(v.index.to_numpy(np.float64), v.to_numpy()))
    if sum(r["rows"] for r in found) <= AT_DRIVER:
        _, x, y, w = _columns(learned.toArrow().combine_chunks().to_batches()[0], shares)
        summed = partial(sums, codes(x, cuts), x, y, w)
    else:
        summed = partial(_summed, learned, cuts, shares)
    trees = grow(summed, cuts, share)
    lines, limits = {}, {}
    scores = _scores(rows.filter("held").select("kind", "label", "x", "n"), shares, trees).orderBy("kind", "label", "z").toPandas()
    for kind in _LIKELY:
        own = scores[scores["kind"] == kind]
        y, z = own["label"].to_numpy(), own["z"].to_numpy() / STEPS
        if len(set(y.tolist())) == 2:
            w = own["n"].to_numpy() * np.array([shares[kind, k] for k in y.tolist()])
            lines[kind] = calibrate(z, y, w=w)
            limits[kind] = threshold(sigmoid(lines[kind][0] * z + lines[kind][1]), y, PRECISION, w)
    return Model(trees, lines, limits) if lines else None


# ------------------------------------------------------------------ the operator

def likely_spans(texts: list[bytes], taken: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """Spans that the model selects, of each text; of those that overlap the likeliest, then the first and longest."""
    found = ((i, *s) for i, (t, own) in enumerate(zip(texts, taken, strict=True)) for s in proposals(t, own))
    chosen = []
    while some := list(islice(found, AT_ONCE)):
        x = np.array([describe(texts[i], kind, a, b, len(taken[i])) for i, kind, a, b in some], dtype=np.float32).astype(np.float64)
        p = model.chances(np.array([s[1] for s in some]), x)
        chosen += [(-float(p[k]), i, a, -b, kind) for k, (i, kind, a, b) in enumerate(some) if p[k] > 0]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[list[int]] = [[] for _ in texts]
    for _, i, a, before, kind in sorted(chosen):
        b = -before
        at = bisect_right(held[i], a)
        # starts and ends of selected spans alternate, so a free place lies between two of them
        if at % 2 == 0 and (at == len(held[i]) or held[i][at] >= b):
            held[i][at:at] = [a, b]
            out[i].append((_LIKELY[kind], a, b))
    return out


def scan_batch(texts: pa.Array, model: Model | None) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) of each text in code points, by start, then kind."""
    raw, off = utf8(texts)
    data = raw.tobytes()
    own = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    spans = [base_spans(t) for t in own]
    if model is not None:
        spans = [s + more for s, more in zip(spans, likely_spans(own, spans, model), strict=True)]
    for i, found in enumerate(spans):
        if found:
            here = np.cumsum((raw[off[i] : off[i + 1]] & 0xC0) != 0x80)
            at = lambda x: int(here[x - 1]) if x else 0  # noqa: E731, B023
            spans[i] = sorted(((k, at(a), at(b)) for k, a, b in found), key=lambda s: (s[1], s[0], s[2]))
    return spans


def scan(documents: DataFrame, model: Model | None = None, learn: bool = True) -> DataFrame:
    """Counts, digest and spans of each text; spans are ``kind:start:end`` joined by commas. Without a model one is fitted to the documents first."""
    if model is None and learn:
        model = fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some hundred small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            _, off = utf8(batch.column(1))
            for lo, hi in slices(off):
                part = batch.slice(lo, hi - lo)
                spans = scan_batch(part.column(1), shared.value)
                count = lambda test: pa.array([sum(test(x[0]) for x in s) for s in spans], pa.int64())  # noqa: E731, B023
                each = [count(lambda k, kind=kind: k == kind) for kind in range(4)]
                base = [hashlib.sha256(write([x for x in s if x[0] < 4]).encode()).hexdigest() for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), *each, pa.array(base, pa.string()), pa.array([write(s) for s in spans], pa.string()), count(lambda k: k > 3)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_likely"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_likely long"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def redact(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``documents`` with each stretch of ``text`` covered by spans replaced by ``<kind>`` of its first span."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))
    at = documents.columns.index("text")

    def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for k, a, b in spans:
            if a >= done:
                out += [text[done:a], f"<{KINDS[k].removeprefix('likely_')}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = utf8(batch.column(at))
            for lo, hi in slices(off):
                part = batch.slice(lo, hi - lo)
                spans = scan_batch(part.column(at), shared.value)
                texts = [replaced(t, s) if s else t for t, s in zip(part.column(at).to_pylist(), spans, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, part.column(at).type), *part.columns[at + 1 :]], schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)
