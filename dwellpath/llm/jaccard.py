"""N-gram Jaccard join by universe partitioning, pigeonhole and exact verification.

Sets are the distinct 5-word shingles of a text. Two sets of sizes x and y with
``4 * common >= 3 * union`` differ in at most ``(x + y) // 7`` elements. Sets fall into size
bands a factor 4/3 apart, so a pair lies in one band or in two neighbouring ones. Each band
cuts the universe of hashes into segments; of ``H + 1 + slack`` segments at most H differ, so
more than ``slack`` agree exactly.

1. Each set indexes the hash of its non-empty segment subsets in its own band and probes the
   band below. A bucket of few sets gives all its pairs; of a larger one the members are noted.
   A set whose large buckets and empty segments are no more than the slack meets every linked
   set in a small bucket too; the others get a star in each of their large buckets.
2. A linked pair shares more segments than the slack less its empty ones, so pairs that share
   fewer are dropped. Of the others each set's best pair is verified on whole texts, then all
   pairs between different components. Most large buckets then lie in one component. Of the
   others, those with few outsiders give the outsiders' pairs.
3. Cost-based allocation for the rest: a set skips (threshold 0) its empty segments and the
   large open buckets. Where it skips no more than the slack, the pigeonhole still holds with
   what was already probed. Only pairs in which *both* sets skip more can be missed. Of these,
   pairs that share a hash which is rare among such sets meet by it. In the others the rare
   hashes are all differences, so only sets with few of them are left; these raise as many other
   segments as they lack to threshold 2 and probe these with their one-deletion neighbourhoods,
   indexed for such sets alone.

Only components are asked for, so pairs already connected need no test; no link between
different components is left untested. Equal sets are one node.

Links are verified on the texts' words. Equal sets are told by a 64-bit key of unstructured
hashes: among n different sets two share a key with a chance of n * n / 2**65.

Defined results: null, empty or wordless texts have n_shingles 0 and are alone; a row whose
doc_id is null is counted but never linked and has no component; repeated rows are equal sets;
rows of one doc_id with different texts are nodes of their own under one id, and a pair's test
reads all texts under its two ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellpath.llm.graph import components
from dwellpath.llm.spark import forget, rested, shuffle_width, stored
from dwellpath.llm.text import exact_sets, scramble, shingle_sets, slices, utf8

_U = np.uint64
#: Sets of one bucket whose pairs are all tested; a larger bucket starts with a star.
SMALL = 32
#: Sets outside a large bucket's main component that are few enough to be tested against all of it.
FEW = 8
#: Bits of the filter that thins a scan for chosen documents; 2 MB when broadcast.
FILTER_BITS = 1 << 23
#: Slots of the table of bucket sizes that costs are read from; 4 MB when broadcast.
COST_SLOTS = 1 << 20
#: Bytes of a signature.
SIG_BYTES = 6
#: Rounds in which a task goes through its signatures; each holds its share of them.
ROUNDS = 4
#: Signatures that a task holds before it sends them on; some 100 bytes each while they are sorted.
FLUSH = 1 << 18
#: Pairs whose bitmaps a task compares at a time; some 100 bytes each while it does.
PAIRS = 1 << 19
#: Tables of pairs, labels and large buckets are written from an eighth of the partitions.
SHARE = 8


def _bands() -> np.ndarray:
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 4 // 3 + 1)
    return np.array(low, dtype=np.int64)


BANDS = _bands()
_LAST = np.append(BANDS[1:] - 1, 1 << 60)


def _slack(band: np.ndarray) -> np.ndarray:
    third = _LAST[band] / 3
    return np.ceil(0.22 * third + 1.2 * np.sqrt(third)).astype(np.int64)


def _segments(band: np.ndarray) -> np.ndarray:
    u = _LAST[band]
    return (u + u * 4 // 3) // 7 + 1 + _slack(band)


def schemes(sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the own band and the band below: band, segments of the band, segments in use.

    The band below is -1 where there is none.
    """
    own = np.searchsorted(BANDS, sizes, side="right") - 1
    used = (sizes + sizes * 4 // 3) // 7 + 1 + _slack(own)
    below = own - 1
    at = np.maximum(below, 0)
    used_below = (sizes + _LAST[at]) // 7 + 1 + _slack(at)
    return [(own, _segments(own), used), (below, _segments(at), np.minimum(used_below, _segments(at)))]


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set of hashes; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(h ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, scramble(total[bounds[1:]] - total[bounds[:-1]] + n * _U(0x2545F4914F6CDD1D)), _U(0))


def _signature(content: np.ndarray, band: np.ndarray, segment: np.ndarray, space: int) -> np.ndarray:
    """Signatures of SIG_BYTES bytes; two that are equal by chance join two buckets, which only adds pairs to test."""
    return scramble(content + scramble(band.astype(np.uint64) * _U(1 << 40) + segment.astype(np.uint64) * _U(4) + _U(space))) >> _U(64 - 8 * SIG_BYTES)


def _share(sig: np.ndarray, parts: int) -> np.ndarray:
    """The share of the hash space that a signature or a hash lies in."""
    return (sig >> _U(16)) % _U(parts)


def _narrow(sig: np.ndarray) -> bytes:
    return np.ascontiguousarray(sig, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes()


def _wide(body: np.ndarray) -> np.ndarray:
    out = np.zeros((len(body) // SIG_BYTES, 8), dtype=np.uint8)
    out[:, :SIG_BYTES] = body.reshape(-1, SIG_BYTES)
    return out.view("<u8").ravel()


def _repeated(sig: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each row, how many of its signatures are equal to another one of its own, which counts in a bucket once."""
    x = scramble(sig + scramble(row.astype(np.uint64) + _U(1)))
    again = np.sort(x)
    again = again[1:][again[1:] == again[:-1]]
    return np.bincount(row[np.isin(x, again)], minlength=rows) if len(again) else np.zeros(rows, np.int64)


def _subsets(h: np.ndarray, bounds: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, segment, first element and summed content of each non-empty segment."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    seg = ((h >> _U(32)) * m[row].astype(np.uint64)) >> _U(32)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (seg[1:] != seg[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    content = np.add.reduceat(scramble(h ^ _U(0x9FB21C651E98DF25)), at) if len(h) else np.zeros(0, np.uint64)
    return row[at], seg[at].astype(np.int64), at, content


# ---------------------------------------------------------------- step 1: signatures

_SENT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("body", pa.binary())])
#: Of a set: its band, then segments in use and filled ones of its own band and of the band below,
#: and what is left of the slack of each after its empty segments.
_NUMBERS = ("n", "band", "own_used", "own_filled", "low_used", "low_filled", "own_spare", "low_spare")
_FOUND = "kind byte, a long, b long, " + ", ".join(f"{c} int" for c in _NUMBERS)
_FOUND_ARROW = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), *[(c, pa.int32()) for c in _NUMBERS]])
#: A set's signatures in one share: how many of its own band, then of the band below.
_ENTRY = np.dtype([("key", "<u8"), ("own", "u1"), ("low", "u1")])
_DOC = np.dtype([("id", "<i8"), ("key", "<u8"), *[(c, "<i4") for c in _NUMBERS], ("null", "u1")])


def _sign(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            ids = batch.column(0)
            raw, off = utf8(batch.column(1))
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            for a, b in slices(off):
                h, bounds = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                n = np.diff(bounds)
                keys = set_keys(h, bounds)
                docs = np.zeros(b - a, dtype=_DOC)
                docs["id"], docs["key"], docs["n"], docs["null"] = ids[a:b], keys, n, null[a:b]
                # equal sets of this slice sign once, by the first row that can be linked
                able = np.flatnonzero((n > 0) & ~null[a:b])
                sign = np.zeros(b - a, dtype=bool)
                sign[able[np.unique(keys[able], return_index=True)[1]]] = True
                sigs, entry_of = [], []
                for own, (band, m, used) in zip((1, 0), schemes(np.maximum(n, 1)), strict=True):
                    row, seg, _, content = _subsets(h, bounds, m)
                    inside = seg < used[row]
                    filled = np.bincount(row[inside], minlength=b - a)
                    name = "own" if own else "low"
                    docs[f"{name}_used"], docs[f"{name}_filled"] = used, filled
                    docs[f"{name}_spare"] = np.where(band >= 0, _slack(np.maximum(band, 0)) - (used - filled), 1 << 20)
                    if own:
                        docs["band"] = band
                    take = inside & sign[row] & (band[row] >= 0)
                    row, seg, content = row[take], seg[take], content[take]
                    sigs.append(_signature(content, band[row], seg, 0))
                    entry_of.append(2 * row + 1 - own)
                sig, entry = np.concatenate(sigs), np.concatenate(entry_of)
                once = _repeated(sig, entry >> 1, b - a)
                if once.any():  # they count as empty segments do, as their buckets show them once
                    for c in ("own_filled", "low_filled", "own_spare", "low_spare"):
                        docs[c] -= once.astype(np.int32)
                held.append((docs, sig, entry, keys))
                size += len(held[-1][1])
                if size > FLUSH:
                    packed = _pack(held, parts)
                    held, size = [], 0
                    yield packed
                    del packed
            del batch, raw, off  # before the next one comes
        if held:
            yield _pack(held, parts)

    return run


def _pack(held: list, parts: int) -> pa.RecordBatch:
    docs = np.concatenate([x[0] for x in held])
    base = np.cumsum([0] + [2 * len(x[3]) for x in held])
    sig = np.concatenate([x[1] for x in held])
    entry = np.concatenate([x[2] + o for x, o in zip(held, base, strict=False)])
    key = np.concatenate([x[3] for x in held])
    part = _share(sig, parts)
    order = np.lexsort((entry, part))
    sig, entry, part = sig[order], entry[order], part[order]
    del order
    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    of, kind, body = [], [], []
    for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a == b:
            continue
        row, low = entry[a:b] >> 1, entry[a:b] & 1
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        counts = np.diff(np.append(heads, b - a))
        long = np.flatnonzero(counts > 255)
        if len(long):  # an entry of very many signatures is written in pieces
            heads = np.unique(np.concatenate([heads, *[np.arange(heads[i], heads[i] + counts[i], 255) for i in long]]))
            counts = np.diff(np.append(heads, b - a))
        table = np.zeros(len(heads), dtype=_ENTRY)
        table["key"], table["low"] = key[row[heads]], np.add.reduceat(low, heads)
        table["own"] = counts - table["low"]
        of.append(p), kind.append(1)
        body.append(np.int64(len(table)).tobytes() + table.tobytes() + _narrow(sig[a:b]))
    place = (docs["key"] >> _U(33)) % _U(parts)
    for p in np.unique(place):
        of.append(int(p)), kind.append(2), body.append(docs[place == p].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(kind, pa.int8()), pa.array(body, pa.binary())], schema=_SENT)


def _rows(kind: int, a, b, numbers: dict, null=None) -> pa.RecordBatch:
    long = lambda x: np.ascontiguousarray(x).view(np.int64)
    empty = pa.nulls(len(a), pa.int32())
    cols = [pa.array(np.ascontiguousarray(numbers[c], dtype=np.int32)) if c in numbers else empty for c in _NUMBERS]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(long(a), mask=null), pa.array(long(b)), *cols], schema=_FOUND_ARROW)


def _counted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with the number of times each came."""
    x, y = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    count = np.diff(np.append(at, len(x)))
    x, y = x[at], y[at]
    keep = x != y
    return x[keep], y[keep], count[keep]


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and noted members from the signatures of one share of the hash space."""
    bodies: list[pa.Buffer] = []
    for batch in batches:
        for kind, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            buf = body.as_buffer()
            if kind == 2:
                d = np.frombuffer(buf, dtype=_DOC)
                yield _rows(2, d["id"], d["key"], {c: d[c] for c in _NUMBERS}, null=d["null"].astype(bool))
            else:
                bodies.append(buf)
    left, right = [], []
    for k in range(ROUNDS):
        sigs, keys, owns = [], [], []
        for buf in bodies:
            t = int(np.frombuffer(buf, np.int64, 1)[0])
            table = np.frombuffer(buf, dtype=_ENTRY, count=t, offset=8)
            sig = _wide(np.frombuffer(buf, dtype=np.uint8, offset=8 + t * _ENTRY.itemsize))
            mine = sig % _U(ROUNDS) == k
            sigs.append(sig[mine])
            keys.append(np.repeat(table["key"], table["own"].astype(np.int64) + table["low"])[mine])
            owns.append(np.repeat(np.tile(np.array([1, 0], np.uint8), t), np.stack([table["own"], table["low"]], axis=1).ravel())[mine])
        if sum(map(len, sigs)):
            yield from _met(np.concatenate(sigs), np.concatenate(keys), np.concatenate(owns), left, right)
    del bodies
    if left:
        x, y, n = _counted_pairs(np.concatenate(left), np.concatenate(right))
        for a in range(0, len(x), 1 << 16):
            b = a + (1 << 16)
            yield _rows(0, x[a:b], y[a:b], {"n": n[a:b]})


def _met(sig: np.ndarray, key: np.ndarray, own: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The members of large buckets; the pairs of small ones go to ``left`` and ``right``."""
    order = np.argsort(sig)
    s = sig[order]
    same = s[1:] == s[:-1]
    shared = np.zeros(len(s), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    sig, key, own = sig[order], key[order], own[order]
    order = np.lexsort((1 - own, key, sig))
    sig, key, own = sig[order], key[order], own[order]
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key, own = sig[fresh], key[fresh], own[fresh]
    if not len(sig):
        return
    heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(heads, len(sig)))
    owners = np.add.reduceat(own.astype(np.int64), heads)
    for c in range(2, SMALL + 1):
        at = heads[(count == c) & (owners > 0)]
        if len(at):
            i, j = np.triu_indices(c, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = (own[x] | own[y]) > 0
            left.append(key[x[ok]]), right.append(key[y[ok]])
    large = np.repeat((count > SMALL) & (owners > 0), count)
    if large.any():
        yield _rows(1, sig[large], key[large], {"n": own[large]})


# ---------------------------------------------------------------- verification

_TESTED = "a long, b long, linked boolean"


def _test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b): whether the texts' sets are a and b and are linked, by their words."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    for batch in batches:
        keys = [np.asarray(batch.column(k)).view(np.uint64) for k in (0, 1)]
        (ra, oa), (rb, ob) = utf8(batch.column(2)), utf8(batch.column(3))
        linked, fits = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        for lo, hi in slices(oa + ob):
            raw = np.concatenate([ra[oa[lo] : oa[hi]], rb[ob[lo] : ob[hi]]])
            off = np.concatenate([oa[lo:hi] - oa[lo], ob[lo : hi + 1] - ob[lo] + oa[hi] - oa[lo]])
            found = set_keys(*shingle_sets(raw, off))
            fits[lo:hi] = (found[: hi - lo] == keys[0][lo:hi]) & (found[hi - lo :] == keys[1][lo:hi])
            x, bounds = exact_sets(raw, off)
            for i in np.flatnonzero(fits[lo:hi]).tolist():
                j = i + hi - lo
                both = np.sort(np.concatenate([x[bounds[i] : bounds[i + 1]], x[bounds[j] : bounds[j + 1]]]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[lo + i] = 4 * common >= 3 * (len(both) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], schema=schema).filter(pa.array(fits))


def with_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of all documents whose doc_id is in ``wanted``, and of few others.

    A bitmap of fixed size over hashed ids thins the scan, so that few texts are shuffled; a join
    by doc_id is to follow.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word, bit = F.expr("cast(slot div 64 as int)"), F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = wanted.select(slot.alias("slot")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = F.broadcast(words)  # at most FILTER_BITS / 64 rows
    d = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).withColumn("slot", slot)
    d = d.withColumn("word", word).join(words, "word").filter("(bits & shiftleft(1L, cast(slot % 64 as int))) <> 0")
    return d.select("doc_id", "text")


def _with_reps(pairs: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    c = classes.select("key", "rep", "n")
    p = pairs.join(c.select(F.col("key").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na")), "a")
    p = p.join(c.select(F.col("key").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb")), "b")
    return p.filter(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")).select("a", "b", *more, "ra", "rb")


def tested(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b, linked) for pairs (a, b, ra, rb) of set keys and documents that have these sets."""
    p = pairs.select("a", "b", "ra", "rb")
    texts = with_texts(documents, p.select(F.explode(F.array("ra", "rb")).alias("doc_id")))
    rows = (
        p.join(texts.select(F.col("doc_id").alias("ra"), F.col("text").alias("ta")), "ra")
        .join(texts.select(F.col("doc_id").alias("rb"), F.col("text").alias("tb")), "rb")
        .select("a", "b", "ta", "tb")
    )
    return stored(rows.mapInArrow(rested(_test), _TESTED))


# ---------------------------------------------------------------- steps 2 and 3

def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    ends = labels.select("node", "component")
    p = pairs.join(ends.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    p = p.join(ends.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return p.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _sharing_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, shared, ra, rb) that share as many segments as a linked pair must.

    Of the segments that both use, at most H differ and at most the emptier one's empty segments
    agree unseen. Shared large buckets are not counted pair by pair, so all large buckets of the
    set that has fewer count as shared.
    """
    names = [x for x in classes.columns if x != "key"]
    p = pairs
    for side in ("a", "b"):
        p = p.join(classes.select(F.col("key").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in names]), side)
    # which band a side takes part with: its own, or the band below when the other set is smaller by a band
    def of(side: str, other: str, what: str):
        return F.when(F.col(f"{side}_band") > F.col(f"{other}_band"), F.col(f"{side}_low_{what}")).otherwise(F.col(f"{side}_own_{what}"))

    used = F.least(of("a", "b", "used"), of("b", "a", "used"))
    empty = F.least(of("a", "b", "used") - of("a", "b", "filled"), of("b", "a", "used") - of("b", "a", "filled"))
    large = F.least(of("a", "b", "large"), of("b", "a", "large"))
    needed = used - F.floor((F.col("a_n") + F.col("b_n")) / 7) - empty
    p = p.filter(4 * F.least("a_n", "b_n") >= 3 * F.greatest("a_n", "b_n")).filter(F.col("shared") + large >= needed)
    return p.select("a", "b", "shared", F.col("a_rep").alias("ra"), F.col("b_rep").alias("rb"))


def _memberships(sets: DataFrame, *more: str) -> DataFrame:
    """(key, more, sig, own): a row for each large bucket that a set lists."""
    def listed(name: str, own: int) -> Column:
        return F.transform(name, lambda s: F.struct(s.alias("sig"), F.lit(own).alias("own")))

    return sets.select("key", *more, F.explode(F.concat(listed("own_sigs", 1), listed("low_sigs", 0))).alias("m")).select("key", *more, "m.sig", "m.own")


def _stars(sets: DataFrame) -> DataFrame:
    """(a, b, shared): each member of a large bucket with the one that has most large buckets."""
    m = stored(_memberships(sets.withColumn("degree", F.size("own_sigs") + F.size("low_sigs")), "degree"), share=SHARE)
    centre = m.filter("own = 1").groupBy("sig").agg(F.max(F.struct("degree", F.col("key").alias("x"))).alias("c")).select("sig", F.col("c.x").alias("x"))
    return m.join(centre, "sig").filter("key <> x").groupBy(*_ordered("key", "x")).agg(F.count(F.lit(1)).alias("shared"))


def _best(pairs: DataFrame) -> DataFrame:
    """For each set the pair that shares most."""
    p = F.struct("shared", "a", "b", "ra", "rb").alias("p")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x"), p)
    return ends.groupBy("x").agg(F.max("p").alias("p")).select("p.a", "p.b", "p.ra", "p.rb").distinct()


def _labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    m = sets.join(labels.select(F.col("node").alias("key"), "component"), "key", "left")
    return m.withColumn("component", F.coalesce("component", "key"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, component, k): how many of a task's sets list a bucket, by component.

    A bucket of more than FEW + 1 components has one row, without a component: it is known to span
    components, and not to be one with few outsiders.
    """
    schema = pa.schema([("sig", pa.int64()), ("component", pa.int64()), ("k", pa.int64())])
    sigs, groups, size = [], [], 0

    def counted() -> pa.RecordBatch:
        sig, group = np.concatenate(sigs), np.concatenate(groups)
        order = np.lexsort((group, sig))
        sig, group = sig[order], group[order]
        at = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (group[1:] != group[:-1])]))
        k, sig, group = np.diff(np.append(at, len(sig))), sig[at], group[at]
        heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        kinds = np.diff(np.append(heads, len(sig)))
        many = kinds > FEW + 1
        alone = ~np.repeat(many, kinds)
        total = np.add.reduceat(k, heads)[many]
        none = pa.array(np.concatenate([group[alone], np.zeros(int(many.sum()), np.int64)]), mask=np.concatenate([np.zeros(int(alone.sum()), bool), np.ones(int(many.sum()), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[alone], sig[heads[many]]])), none, pa.array(np.concatenate([k[alone], total]).astype(np.int64))], schema=schema)

    for batch in batches:
        component = np.asarray(batch.column(2))
        for lists in (batch.column(0), batch.column(1)):
            start = np.asarray(lists.offsets).astype(np.int64)
            sigs.append(np.asarray(lists.values)[start[0] : start[-1]])
            groups.append(np.repeat(component, np.diff(start)))
            size += len(sigs[-1])
        if size > FLUSH:
            yield counted()
            sigs, groups, size = [], [], 0
    if size:
        yield counted()


def _spanning(sets: DataFrame) -> DataFrame:
    """Large buckets whose listed members lie in several components: sig, main (their main component) and few.

    ``few``: whether at most FEW members lie outside the main component.
    """
    parts = sets.select("own_sigs", "low_sigs", "component").mapInArrow(rested(_parts), "sig long, component long, k long").groupBy("sig", "component").agg(F.sum("k").alias("k"))
    main = parts.groupBy("sig").agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("parts"), F.max(F.col("component").isNull()).alias("many"), F.max(F.when(F.col("component").isNotNull(), F.struct("k", "component"))).alias("m"))
    few = ~F.col("many") & (F.col("size") - F.col("m.k") <= FEW)
    return main.filter("parts > 1 or many").select("sig", F.col("m.component").alias("main"), few.alias("few"))


def _listing(sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """``sets`` with their lists thinned to ``buckets`` and few others, by a bitmap of a fixed size."""
    slot = F.pmod(F.shiftrightunsigned("sig", 7), F.lit(FILTER_BITS))
    word, bit = F.expr("cast(slot div 64 as int)"), F.expr("shiftleft(1L, cast(slot % 64 as int))")
    found = buckets.select(slot.alias("slot")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most FILTER_BITS / 64 rows
    words = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shared = sets.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("array<long>")
    def thinned(lists: pa.Array) -> pa.Array:
        start, sigs = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
        at = ((sigs.view(np.uint64) >> _U(7)) % _U(FILTER_BITS)).astype(np.int64)
        keep = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) > 0
        before = np.concatenate([[0], np.cumsum(keep)])[start]
        return pa.ListArray.from_arrays(pa.array(before - before[0], pa.int32()), pa.array(sigs[start[0] : start[-1]][keep[start[0] : start[-1]]]))

    return sets.withColumn("own_sigs", thinned("own_sigs")).withColumn("low_sigs", thinned("low_sigs"))


def _open(sets: DataFrame, but: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled sets that still matter, with the large buckets that they would skip; and these buckets.

    A bucket matters while it spans components (``but`` those settled otherwise). A set matters
    while the buckets that it would skip, with its empty segments, are more than the slack:
    otherwise every set linked to it also shares a small bucket with it and was met there.
    """
    buckets = _spanning(sets)
    if but is not None:
        buckets = buckets.join(but.select("sig"), "sig", "left_anti")
    buckets = stored(buckets, share=SHARE)
    kept = _listing(sets, buckets).filter((F.col("own_spare") < F.size("own_sigs")) | (F.col("low_spare") < F.size("low_sigs")))
    return stored(kept, share=SHARE), buckets


def _of_few(sets: DataFrame, few: DataFrame) -> DataFrame:
    """(a, b): the pairs of the outsiders of ``few`` buckets with all their other members."""
    m = stored(_memberships(_listing(sets, few), "component").join(few.select("sig", "main"), "sig"), share=SHARE)
    one = m.filter("component <> main").select("sig", F.col("key").alias("x"), F.col("component").alias("cx"), F.col("own").alias("ox"))
    return one.join(m.drop("main"), "sig").filter("component <> cx and ox + own > 0").select(*_ordered("x", "key")).distinct()


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _plan(x: np.ndarray, entry: tuple, skip: np.ndarray) -> dict | None:
    """What a set lacks in one of its bands: None if it skips no more than the slack."""
    band, m, used = (int(e[0]) for e in entry)
    if band < 0:
        return None
    _, seg, at, content = _subsets(x, np.array([0, len(x)]), np.array([m]))
    end = np.append(at[1:], len(x))
    inside = seg < used
    seg, at, end, content = seg[inside], at[inside], end[inside], content[inside]
    plain = _signature(content, np.full(len(seg), band), seg, 0)
    hot = np.isin(plain, skip)
    empty = np.setdiff1d(np.arange(used), seg)
    lacking = len(empty) + int(hot.sum()) - int(_slack(np.array([band]))[0])
    if lacking <= 0:
        return None
    sizes = end - at
    owner = np.repeat(np.arange(len(seg)), sizes)
    element = np.concatenate([np.arange(a, b) for a, b in zip(at, end, strict=True)]) if len(seg) else np.zeros(0, np.int64)
    less = content[owner] - scramble(x ^ _U(0x9FB21C651E98DF25))[element]
    return {"band": band, "seg": seg, "content": content, "plain": plain, "hot": hot, "empty": empty, "lacking": lacking, "sizes": sizes, "owner": owner, "less": less}


def _sets_of(batches: Iterator[pa.RecordBatch], *lists: int):
    """(key, set, lists) of rows (key, text, lists) whose text has the set of the key."""
    for batch in batches:
        raw, off = utf8(batch.column(1))
        keys = np.asarray(batch.column(0)).view(np.uint64)
        for lo, hi in slices(off):
            h, bounds = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for i in np.flatnonzero(set_keys(h, bounds) == keys[lo:hi]).tolist():
                found = [np.asarray(batch.column(c)[lo + i].values, dtype=np.int64) if batch.column(c)[lo + i].is_valid else np.zeros(0, np.int64) for c in lists]
                yield keys[lo + i], h[bounds[i] : bounds[i + 1]], found
        yield None


def _bucket_sizes(large: DataFrame) -> np.ndarray:
    """The size of the largest bucket in each of COST_SLOTS slots of hashed signatures, whatever the input's size."""
    sizes = large.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    slot = F.pmod(F.shiftrightunsigned("sig", 7), F.lit(COST_SLOTS)).cast("int")
    found = sizes.groupBy(slot.alias("slot")).agg(F.max("size").cast("int").alias("size")).toPandas()  # at most COST_SLOTS rows
    out = np.zeros(COST_SLOTS, dtype=np.int32)
    out[found["slot"].to_numpy()] = found["size"].to_numpy()
    return out


def _choose(p: dict, sizes: np.ndarray) -> np.ndarray:
    """The segments on which a set places the units that it lacks, by cost.

    Raising a segment costs its probes and the large buckets that they might hit; counting a
    skipped one again costs its own bucket. A segment of one element comes late, as without it
    the segment is empty, and empty segments come last, as every sparse set is in their bucket.
    """
    size_of = lambda sig: sizes[((sig >> _U(7)) % _U(COST_SLOTS)).astype(np.int64)].astype(np.int64)
    seg, owner = p["seg"], p["owner"]
    probes = _signature(p["less"], np.full(len(owner), p["band"]), seg[owner], 0)
    cost = p["sizes"] + np.bincount(owner, weights=size_of(probes), minlength=len(seg)).astype(np.int64)
    cost = np.where(p["hot"], size_of(p["plain"]), np.where(p["sizes"] == 1, 1 << 30, cost))
    segs, costs = np.concatenate([seg, p["empty"]]), np.concatenate([cost, np.full(len(p["empty"]), 1 << 32)])
    return segs[np.lexsort((segs, costs))[: p["lacking"]]]


def _bitmap(x: np.ndarray, band: int) -> np.ndarray:
    """The set's hashes on a bitmap of a size fixed for the band, 16 to 32 bits an element; 64-bit words."""
    bits = min(18, max(8, int(_LAST[band]).bit_length() + 4))
    at = (scramble(x) >> _U(64 - bits)).astype(np.int64)
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    np.bitwise_or.at(words, at >> 6, _U(1) << (at & 63).astype(np.uint64))
    return words


def _dealt(docs: list[tuple], out: list[tuple[np.ndarray, int, int]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for the shares of the hash space: (hashes, number of doc, role) in ``out``, with the docs that each share needs."""
    if not out:
        return
    n = [len(o[0]) for o in out]
    sig, doc, role = np.concatenate([o[0] for o in out]), np.repeat([o[1] for o in out], n), np.repeat([o[2] for o in out], n)
    part = _share(sig, parts).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[k] : cuts[k + 1]]
        used, local = np.unique(doc[at], return_inverse=True)
        body = pickle.dumps((sig[at], local.astype(np.int32), role[at].astype(np.int8), [docs[i] for i in used]))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([3], pa.int8()), pa.array([body], pa.binary())], schema=_SENT)


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """What ``_dealt`` sent to one share: hashes, numbers of docs, roles and docs."""
    sigs, docs, roles, table = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], []
    for batch in batches:
        for body in batch.column(2).to_pylist():
            sig, doc, role, rows = pickle.loads(body)
            sigs.append(sig), docs.append(doc.astype(np.int64) + len(table)), roles.append(role)
            table += rows
    return np.concatenate(sigs), np.concatenate(docs), np.concatenate(roles), table


def _spread(parts: int):
    """Rows (key, text, component): each set's hashes, by shares of the hash space, for both of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, out = [], []
        for found in _sets_of(batches, 2):
            if found is None:
                yield from _dealt(docs, out, parts)
                docs, out = [], []
                continue
            key, x, (group,) = found
            for own, (band, _, _) in zip((1, 0), schemes(np.array([len(x)])), strict=True):
                if band[0] >= 0:
                    out.append((x, len(docs), 0))
                    docs.append((int(key), len(x), own, _bitmap(x, int(band[0])), int(group[0]), 0))

    return run


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share a rare hash (kind 0), and how many rare hashes a set has in this share, if any (kind 1)."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
    sig, doc, _, table = _received(batches)
    if not table:
        return
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(heads, len(sig)))
    rare = np.repeat(count <= 2 * SMALL, count)  # most sets come twice, once for each band
    n = np.bincount(doc[rare], minlength=len(table))
    some = np.array([t[2] for t in table], dtype=bool) & (n > 0)
    keys = np.array([t[0] for t in table], np.uint64).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(some.sum()), np.int8)), pa.array(keys[some]), pa.array(n[some].astype(np.int64))], schema=schema)

    def pairs() -> Iterator[np.ndarray]:
        for c in range(2, 2 * SMALL + 1):
            at, (i, j) = heads[count == c], np.triu_indices(c, 1)
            for lo in range(0, len(at), max(1, PAIRS // len(i))):
                some = at[lo : lo + max(1, PAIRS // len(i)), None]
                yield doc[(some + i).ravel()] * len(table) + doc[(some + j).ravel()]

    for found in _possible(pairs(), table, pa.schema(list(schema)[1:])):
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(found.num_rows, np.int8)), *found.columns], schema=schema)


def _allocate(parts: int, bucket_sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index (role 0) and probe (role 1) entries of sets with their chosen segments, by shares of the hash space.

        Rows (key, text, signatures to skip, component and number of rare hashes). A chosen segment
        that was skipped counts again; any other is raised to threshold 2.
        """
        sizes = bucket_sizes.value
        docs: list[tuple] = []
        out: list[tuple[np.ndarray, int, int]] = []
        for found in _sets_of(batches, 2, 3):
            if found is None:
                yield from _dealt(docs, out, parts)
                docs, out = [], []
                continue
            key, x, (skip, (group, rare)) = found
            for own, entry in zip((1, 0), schemes(np.array([len(x)])), strict=True):
                p = _plan(x, entry, skip.view(np.uint64))
                if p is not None:
                    out += [(sig, len(docs), role) for sig, role in _entries(p, _choose(p, sizes))]
                    docs.append((int(key), len(x), own, _bitmap(x, p["band"]), int(group), int(rare)))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a probing and an indexed set whose bitmaps leave a link possible.

    A bit that one set has and the other hasn't stands for at least one element that is not
    common, so the bound never loses a linked pair. Pairs that share a rare hash were met before;
    of others the rare hashes of both are not common, so only indexed sets with few enough are
    looked at. Sets of the signature's main component are not compared with each other.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    sig, doc, role, table = _received(batches)
    if not table:
        return
    size, group, rare = (np.array([t[k] for t in table], np.int64) for k in (1, 4, 5))
    # the largest partner is larger by a third
    left = (size + size * 4 // 3) // 7 - rare
    order = np.lexsort((rare[doc], role, sig))
    sig, doc, role = sig[order], doc[order], role[order]
    heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    ends = np.append(heads[1:], len(sig))
    # within a signature the indexed sets come first
    indexed = np.concatenate([[0], np.cumsum(role == 0)])
    middle = heads + indexed[ends] - indexed[heads]
    met = (middle > heads) & (ends > middle)

    def cross(probes: np.ndarray, index: np.ndarray) -> Iterator[np.ndarray]:
        """Probes with the indexed sets whose rare hashes are few enough; ``index`` has these in order."""
        many = np.searchsorted(rare[index], left[probes], side="right")
        ends = np.cumsum(many)
        lo = 0
        while lo < len(probes):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            k = many[lo:hi]
            at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            yield np.repeat(probes[lo:hi], k) * len(table) + index[at]
            lo = hi

    def pairs() -> Iterator[np.ndarray]:
        for a, m, b in zip(heads[met].tolist(), middle[met].tolist(), ends[met].tolist(), strict=True):
            index, probes = doc[a:m], doc[m:b]
            names, counts = np.unique(group[index], return_counts=True)
            main = names[np.argmax(counts)]
            outside, probing = group[index] != main, group[probes] == main
            yield from cross(probes[probing], index[outside])
            yield from cross(probes[~probing], index)

    yield from _possible(pairs(), table, schema)


def _possible(found: Iterator[np.ndarray], table: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of pairs of docs (numbers in ``table``, the first times its length plus the second) those that can be linked."""
    held, n = [], 0
    for pairs in found:
        held.append(pairs)
        n += len(pairs)
        if n >= PAIRS:
            yield from _compared(np.concatenate(held), table, schema)
            held, n = [], 0
    if n:
        yield from _compared(np.concatenate(held), table, schema)


def _compared(seen: np.ndarray, table: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    keys, size, own, group = np.array([t[0] for t in table], np.uint64), *(np.array([t[k] for t in table]) for k in (1, 2, 4))
    x, y = np.divmod(np.unique(seen), len(table))
    fits = (keys[x] != keys[y]) & (group[x] != group[y]) & (own[x] + own[y] > 0) & (4 * np.minimum(size[x], size[y]) >= 3 * np.maximum(size[x], size[y]))
    x, y = x[fits], y[fits]
    if not len(x):
        return
    width = np.array([len(t[3]) for t in table])
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        where = np.zeros(len(table), np.int64)
        where[of] = np.arange(len(of))
        words = np.stack([table[i][3] for i in of])
        both = (width[x] == w) & (width[y] == w)
        p, q = x[both], y[both]
        for lo in range(0, len(p), max(1, (1 << 19) // int(w))):
            i, j = p[lo : lo + max(1, (1 << 19) // int(w))], q[lo : lo + max(1, (1 << 19) // int(w))]
            bi, bj = words[where[i]], words[where[j]]
            common = np.minimum(size[i] - np.bitwise_count(bi & ~bj).sum(axis=1, dtype=np.int64), size[j] - np.bitwise_count(bj & ~bi).sum(axis=1, dtype=np.int64))
            ok = 7 * common >= 3 * (size[i] + size[j])
            a, b = keys[i[ok]].view(np.int64), keys[j[ok]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)


def _entries(p: dict, chosen: np.ndarray) -> list[tuple[np.ndarray, int]]:
    band, seg, content, owner, less, empty = (p[k] for k in ("band", "seg", "content", "owner", "less", "empty"))
    zero = np.zeros(len(empty), np.uint64)
    sign = lambda c, g, space: _signature(c, np.full(len(g), band), g, space)
    index = [(sign(np.concatenate([content, zero]), np.concatenate([seg, empty]), 1), 0), (sign(less, seg[owner], 2), 0)]
    raised = np.isin(seg, chosen) & ~p["hot"]
    again = np.isin(seg, chosen) & p["hot"]
    blank = np.intersect1d(empty, chosen)
    of_raised = raised[owner]
    probes = [sign(content[raised], seg[raised], 2), sign(less[of_raised], seg[owner][of_raised], 1)]
    probes += [sign(content[again], seg[again], 1), sign(np.zeros(len(blank), np.uint64), blank, 1)]
    return [*index, (np.concatenate(probes), 1)]


def _late_pairs(sets: DataFrame, large: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidate pairs of sets that both skip more segments than their slack.

    The universe is parted once more, into hashes that are rare among these sets and others. A
    linked pair shares a rare hash, and then meets there, or else the rare hashes of both are among
    the elements in which they differ. So only sets with few rare hashes go on to the cost-based
    allocation: each has as many units to place as it lacks, and places them where they cost least.
    """
    spark = documents.sparkSession
    parts = shuffle_width(spark)
    texts = with_texts(documents, sets.select(F.col("rep").alias("doc_id")))
    held = stored(sets.join(texts, F.col("rep") == F.col("doc_id")).select("key", "text", F.concat("own_sigs", "low_sigs").alias("sigs"), "component", "n"))
    tokens = held.select("key", "text", F.array("component").alias("component")).mapInArrow(rested(_spread(parts)), "part int, kind byte, body binary")
    found = stored(tokens.repartitionById(parts, F.col("part")).mapInArrow(rested(_rare), "kind byte, a long, b long"), "kind")
    rare = found.filter("kind = 1").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("rare"))
    common = held.join(rare, "key", "left").withColumn("rare", F.coalesce("rare", F.lit(0))).filter(3 * F.col("rare") <= F.col("n")).select("key", "text", "sigs", F.array("component", "rare").alias("more"))
    bucket_sizes = spark.sparkContext.broadcast(_bucket_sizes(large))
    sent = common.mapInArrow(rested(_allocate(parts, bucket_sizes)), "part int, kind byte, body binary").repartitionById(parts, F.col("part"))
    met = sent.mapInArrow(rested(_meet), "a long, b long")
    return met.unionByName(found.filter("kind = 0").select("a", "b")).distinct()


def set_key(text: Column) -> Column:
    """The key of a text's set, which is what ``join_components`` calls a row's ``key``; 0 for the empty set.

    Never null. It is marked as if a second call could differ, so that no filter on it is moved below
    it: the texts would go through two Python workers a task, one for the filter and one for the key.
    """

    @F.arrow_udf("long")
    def keys(texts: pa.Array) -> pa.Array:
        raw, off = utf8(texts)
        found = [set_keys(*shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in slices(off)]
        return pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())

    return keys.asNondeterministic()(text)


def join_components(documents: DataFrame, with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (see the module's text).

    ``with_key`` adds the key of each row's set, which tells rows of one doc_id apart.
    """
    spark = documents.sparkSession
    parts = shuffle_width(spark)
    sent = documents.select("doc_id", "text").mapInArrow(rested(_sign(parts)), "part int, kind byte, body binary")
    found = stored(sent.repartitionById(parts, F.col("part")).mapInArrow(rested(_bucket), _FOUND), "kind")
    docs = found.filter("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), *_NUMBERS)
    large = found.filter("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("key"), F.col("n").alias("own"))
    # a set has no more large buckets than segments
    lists = large.groupBy("key").agg(*[F.collect_list(F.when(F.col("own") == own, F.col("sig"))).alias(f"{c}_sigs") for c, own in (("own", 1), ("low", 0))])
    classes = docs.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in _NUMBERS])
    classes = classes.join(lists, "key", "left")
    for c in ("own", "low"):
        classes = classes.withColumn(f"{c}_sigs", F.coalesce(f"{c}_sigs", F.array().cast("array<long>"))).withColumn(f"{c}_large", F.size(f"{c}_sigs"))
    classes = stored(classes)
    # only sets whose large buckets and empty segments outnumber the slack can miss a partner elsewhere
    sets = classes.filter("own_spare < own_large or low_spare < low_large").select("key", "rep", "n", "own_spare", "low_spare", "own_sigs", "low_sigs")
    classes = classes.drop("own_sigs", "low_sigs")
    shared = found.filter("kind = 0").select("a", "b", F.col("n").alias("shared")).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = _sharing_enough(shared, classes).unionByName(_with_reps(_stars(sets), classes, "shared"))
    pairs = stored(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("ra").alias("ra"), F.first("rb").alias("rb")), share=SHARE)
    # each set's best candidate first: most of what is alike is then connected
    done = tested(_best(pairs), documents)
    labels = stored(components(done.filter("linked")), share=SHARE)
    done, labels = _tested_too(_across(pairs, labels), done, labels, documents)
    sets, buckets = _open(_labelled(sets, labels))
    if not sets.isEmpty():
        # few outsiders: all their pairs, and the bucket is settled
        few = buckets.filter("few")
        done, labels = _tested_too(_with_reps(_of_few(sets, few), classes), done, labels, documents)
        sets, _ = _open(_labelled(sets.drop("component"), labels), few)
    if not sets.isEmpty():
        done, labels = _tested_too(_with_reps(_late_pairs(sets, large, documents), classes), done, labels, documents)
    reps = classes.select("key", "rep")
    smallest = labels.join(reps, F.col("node") == F.col("key")).groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labels.join(smallest, "component").select(F.col("node").alias("key"), "component_id")
    named = reps.join(named, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    linked = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    more = ["key"] if with_key else []
    return docs.join(named, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), linked.alias("component_id"), *more)


def _tested_too(pairs: DataFrame, done: DataFrame, labels: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tests and components with those of ``pairs`` that were not tested yet."""
    pairs = stored(pairs.join(done, ["a", "b"], "left_anti"), share=SHARE)
    if pairs.isEmpty():
        return done, labels
    now = tested(pairs, documents)
    done = done.unionByName(now)
    if not now.filter("linked").isEmpty():
        before, labels = labels, stored(components(done.filter("linked")), share=SHARE)
        forget(before)
    return done, labels
