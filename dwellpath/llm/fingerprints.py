"""Document fingerprints: one-permutation MinHash with optimal densification, packed low bits.

Each distinct 5-word shingle is hashed once; the top bits name its bin and a bin keeps its
smallest hash. An empty bin takes the value of the first filled bin in its own fixed random
order of all bins (the same order for every text). Of each bin the low ``BITS`` bits are kept.
Two sets of likeness J agree in a bin with chance ``J + (1 - J) / 2**BITS``, so the likeness
is read back as ``(m - c) / (1 - c)`` with c the share that agrees by chance.

Defined results: a null text is empty; a text without words has the empty fingerprint, like
itself (1.0) and unlike any other (0.0); equal texts have equal fingerprints; an empty table
gives no rows; rows with one doc_id are ordered by a hash of the text, null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.llm.spark import cut, shuffle_width
from dwellpath.llm.text import scramble, shingle_sets, slices, utf8

BINS = 512
BITS = 2
TRIES = 24
_CHANCE = 1.0 / (1 << BITS)
_U = np.uint64


def _orders() -> np.ndarray:
    """For each bin, the fixed random order in which it asks the bins."""
    g = np.random.Generator(np.random.PCG64(977))
    return np.argsort(g.random((BINS, BINS)), axis=1).astype(np.int32)


_ORDER = _orders()
_PLACE = np.argsort(_ORDER, axis=1).astype(np.int32)
_SALT = scramble(np.arange(1, BINS + 1, dtype=np.uint64))


def sketch(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of BINS low-bit values for each sorted set of shingle hashes; empty sets give zeros."""
    rows = len(bounds) - 1
    values = np.zeros((rows, BINS), dtype=np.uint64)
    filled = np.zeros((rows, BINS), dtype=bool)
    if len(h):
        row = np.repeat(np.arange(rows), np.diff(bounds))
        slot = (h >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.ones(len(h), dtype=bool)
        first[1:] = (slot[1:] != slot[:-1]) | (row[1:] != row[:-1])
        values[row[first], slot[first]] = h[first]
        filled[row[first], slot[first]] = True
    some = filled.any(axis=1)
    r, c = np.nonzero(~filled & some[:, None])
    for t in range(TRIES):
        if not len(r):
            break
        j = _ORDER[c, t]
        hit = filled[r, j]
        values[r[hit], c[hit]] = values[r[hit], j[hit]]
        r, c = r[~hit], c[~hit]
    change = np.flatnonzero(r[1:] != r[:-1]) + 1
    for rest in np.split(np.arange(len(r)), change) if len(r) else ():  # texts with few filled bins
        have = np.flatnonzero(filled[r[rest[0]]])
        empty = c[rest]
        values[r[rest], empty] = values[r[rest], have[np.argmin(_PLACE[empty][:, have], axis=1)]]
    # a value that fills several bins shows other low bits in each, so that unlike texts agree by chance alone
    low = scramble(values + _SALT) & _U((1 << BITS) - 1)
    return np.where(some[:, None], low, _U(0)).astype(np.uint8)


def _pack(values: np.ndarray) -> np.ndarray:
    per = 8 // BITS
    v = values.reshape(len(values), -1, per)
    out = np.zeros(v.shape[:2], dtype=np.uint8)
    for k in range(per):
        out |= v[:, :, k] << np.uint8(BITS * (per - 1 - k))
    return out


def likeness(x: np.ndarray, y: np.ndarray, some_x: np.ndarray, some_y: np.ndarray) -> np.ndarray:
    """Bias-corrected likeness of sketches, row by row."""
    m = (x == y).mean(axis=1)
    j = np.clip((m - _CHANCE) / (1 - _CHANCE), 0.0, 1.0)
    return np.where(some_x & some_y, j, (~some_x & ~some_y).astype(np.float64))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_ROW = "kind byte, place int, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_SCHEMA = pa.schema(
    [("kind", pa.int8()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
     ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
)


def _sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = utf8(texts)
    values, some = [np.zeros((0, BINS), np.uint8)], [np.zeros(0, bool)]
    for a, b in slices(off):
        h, bounds = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        values.append(sketch(h, bounds))
        some.append(np.diff(bounds) > 0)
    return np.concatenate(values), np.concatenate(some)


def _compare(ids: list, texts: list[str], nexts: list[str], chained: bool, place: int) -> pa.RecordBatch:
    """Finished rows of ``texts`` with their following texts; chained: each is the next row's text."""
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    if chained:
        both = _sketches(pa.array([*texts, nexts[-1]], pa.large_string()))
        own, foll = (both[0][:-1], both[1][:-1]), (both[0][1:], both[1][1:])
    else:
        own, foll = _sketches(pa.array(texts, pa.large_string())), _sketches(pa.array(nexts, pa.large_string()))
    new = _sketches(pa.array(changed, pa.large_string()))
    code = lambda s: [p.tobytes() if k else b"" for p, k in zip(_pack(s[0]), s[1].tolist(), strict=True)]
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, place, np.int32)), pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()), pa.array(code(own), pa.binary()), pa.array(code(new), pa.binary()),
            pa.array(likeness(own[0], new[0], own[1], new[1])), pa.array(likeness(own[0], foll[0], own[1], foll[1])), pa.nulls(n, pa.string()),
        ],
        schema=_SCHEMA,
    )


def _edge(kind: int, place: int, doc_id, text: str) -> pa.RecordBatch:
    values = [kind, place, doc_id, len(text), None, None, None, None, None, text]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA, strict=True)], schema=_SCHEMA)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids in order: every row but the last meets its follower here.

    The first row goes out as kind 1 and the last as kind 2, to meet across ranges.
    """
    place = TaskContext.get().partitionId()
    held: tuple | None = None
    for batch in batches:
        _, off = utf8(batch.column(1))
        for a, b in slices(off):
            ids = batch.column(0).slice(a, b - a).to_pylist()
            texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
            if held is None:
                yield _edge(1, place, ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(texts) > 1:
                yield _compare(ids[:-1], texts[:-1], texts[1:], True, place)
            held = (ids[-1], texts[-1])
    if held is not None:
        yield _edge(2, place, *held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, nexts = (batch.column(k).to_pylist() for k in range(3))
        if ids:
            yield _compare(ids, texts, nexts, False, 0)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Followers by descending doc_id: the texts are dealt out once, by ranges of ids; within a
    range a row's follower is the next row, and one row a range meets the next range's first.
    """
    spark = documents.sparkSession
    # the ranges are found from samples of the order, so no text is in it
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = documents.select("doc_id", "text").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order, "text")
    walked = cut(rows.mapInArrow(_walk, _ROW))
    firsts = walked.filter("kind = 1").select("place", F.col("text").alias("following"))
    # a number for each range, not for each row
    places = sorted(r["place"] for r in firsts.select("place").collect())
    after = list(zip(places, [*places[1:], *places[:1]], strict=True))
    follows = spark.createDataFrame(after, "place int, after int")
    lasts = walked.filter("kind = 2").select("place", "doc_id", "text").join(F.broadcast(follows), "place").select("doc_id", "text", "after")
    met = lasts.join(firsts, F.col("after") == firsts["place"]).select("doc_id", "text", "following").mapInArrow(_meet, _ROW)
    out = walked.filter("kind = 0").drop("text").unionByName(met.drop("text"))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
