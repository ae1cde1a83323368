"""Records of large JSON files in parallel, with their place in the file.

A file is a list of records, or an object that holds such a list under a name. Spark's text reader
cuts it at closing braces, so a file is read in byte ranges like any text, from any store that
Spark reads. Whether a brace closes a record depends on all text before it, but only through two
things, being inside a string and the depth: a first pass takes what each range does to them, sums
over a file's ranges give every range its start, and a second pass cuts out the records. A record
that goes on into the next range is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellpath.sources.scratch import staged

_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _LIST, _END = b'"\\{}[]'
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_SURVEY = "file string, block long, quotes long, outside long, inside long, first string"
_CUT = "file string, block long, seq long, part int, name string, value string"
#: Parts of records: whole, begun here and open at the end of the range, the rest of one begun earlier, a range in the midst of one; and the last name seen.
WHOLE, BEGUN, REST, MIDST, NAME = range(5)


def _fragments(spark: SparkSession, path: str, sep: str) -> DataFrame:
    raw = spark.read.option("lineSep", sep).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """((file, block), whether it begins here, rows): a task may read several ranges, each in order."""
    last = None
    for batch in batches:
        ends = set()
        for k in (0, 1):
            ends |= set(pc.run_end_encode(batch.column(k)).run_ends.to_pylist())
        a = 0
        for b in sorted(ends):
            at = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
            yield at, at != last, batch.slice(a, b - a)
            last, a = at, b


def _structure(values: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of fragments, +1 or -1 of opening and closing brackets outside strings, number of quotes so far)."""
    text = pc.binary_join_element_wise(values.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"}", pa.large_binary()))  # with the brace that the reader took away
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    quote = raw == _QUOTE
    slash = raw == _BACKSLASH
    if slash.any():
        # a quote is part of a string where an odd number of backslashes stands before it
        at = np.arange(len(raw))
        since = at - np.maximum.accumulate(np.where(slash, -1, at))
        quote[1:] &= since[:-1] % 2 == 0
    quotes = np.cumsum(quote) + start
    step = ((raw == _OPEN) | (raw == _LIST)).astype(np.int8) - ((raw == _CLOSE) | (raw == _END)).astype(np.int8)
    return raw, offsets - offsets[0], step, quotes


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[tuple[str, int], list] = {}
    for at, _, rows in _ranges(batches):
        own = out.setdefault(at, [0, 0, 0, None])
        raw, _, step, quotes = _structure(rows.column(2), own[0])
        own[0] = int(quotes[-1]) if len(quotes) else own[0]
        even = quotes % 2 == 0
        own[1] += int(step[even].sum())
        own[2] += int(step[~even].sum())
        own[3] = own[3] or raw.tobytes()[:4096].decode(errors="replace").strip("﻿ \t\r\n")[:1] or None
    rows = [(*at, *own) for at, own in out.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "block", "quotes", "outside", "inside", "first"])


def _starts(survey: DataFrame) -> DataFrame:
    """(file, block, start_quotes, start_depth, base): the state at the start of each range; records lie at depth ``base``."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    s = survey.withColumn("start_quotes", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    s = s.withColumn("delta", F.when(F.col("start_quotes") == 0, F.col("outside")).otherwise(F.col("inside")))
    s = s.withColumn("start_depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    first = F.first("first", ignorenulls=True).over(to_here)
    return s.select("file", "block", "start_quotes", "start_depth", F.when(first == "[", 1).otherwise(2).alias("base"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, value, start_quotes, start_depth, base) of ranges in order, cut into records and parts."""
    at = held = name = None
    place = quotes = depth = 0
    out: list[tuple] = []

    def finish() -> list[tuple]:
        last = [(*at, held[0], BEGUN if held[0] is not None else MIDST, held[1], b"".join(held[2]))] if held else []
        return [*last, (*at, None, NAME, name, None)] if at and name is not None else last

    for here, begins, rows in _ranges(batches):
        if begins:
            out += finish() if at else []
            at, name = here, None
            quotes, depth, base = (rows.column(k)[0].as_py() for k in (3, 4, 5))
            place = here[1] + (1 if here[1] else 0)  # a range's first fragment begins after its first byte
            held = [None, None, []] if depth > base else None
        raw, offsets, step, counted = _structure(rows.column(2), quotes)
        data = raw.tobytes()
        inner = counted % 2 == 1
        step = np.where(inner, 0, step)
        levels = depth + np.cumsum(step, dtype=np.int64)
        opens = (step > 0) & (levels == base + 1) & (raw == _OPEN)
        closes = (step < 0) & (levels == base) & (raw == _CLOSE)
        names = (step > 0) & (levels == 2) if base == 2 else np.zeros(len(raw), dtype=bool)
        of = np.searchsorted(offsets, np.flatnonzero(opens | closes | names), side="right") - 1
        copied = 0
        for p, fragment in zip(np.flatnonzero(opens | closes | names).tolist(), of.tolist(), strict=True):
            if names[p]:
                # what an object holds are no records
                m = _NAME.search(data[int(offsets[fragment]) : p]) if raw[p] == _LIST else None
                name = m.group(1).decode() if m else ""
            elif opens[p]:
                held, copied = [place + int(offsets[fragment]), name, []], p
            elif held:
                held[2].append(data[copied : p + 1])
                out.append((*at, held[0], WHOLE if held[0] is not None else REST, held[1], b"".join(held[2])))
                held = None
        if held:
            held[2].append(data[copied:])
        quotes, depth, place = int(counted[-1]) % 2 if len(counted) else quotes, int(levels[-1]) if len(levels) else depth, place + len(data)
        if len(out) > 2000:
            yield _parts(out)
            out = []
    out += finish() if at else []
    yield _parts(out)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary())
    arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], names=["file", "block", "seq", "part", "name", "value"])


def json_records(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, seq, value): the text of each record of list files and of objects' lists under ``name``.

    ``seq`` grows with the record's place in its file. Files are parted by Spark's settings for text.
    """
    fragments = _fragments(spark, path, "}")
    starts = staged(_starts(fragments.mapInArrow(_survey, _SURVEY)))
    # a row for each range of a file
    located = fragments.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "start_quotes", "start_depth", "base")
    parts = staged(located.mapInArrow(_cut, _CUT))
    # at most three rows a range: a record that is begun, the rest of an earlier one, and the last name
    back = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    edges = parts.filter(F.col("part") != WHOLE)
    pieces = edges.filter(F.col("part") != NAME).withColumn("_order", F.struct("block", F.when(F.col("part") == BEGUN, 1).otherwise(0)))
    # a rest belongs to what was begun last, if nothing has ended since; other rests are parts of what is no record
    begun = F.struct("seq", "name", "block")
    event = F.when(F.col("part") == BEGUN, F.struct(F.lit(True).alias("open"), begun.alias("own"))).when(F.col("part") == REST, F.struct(F.lit(False).alias("open"), F.lit(None).cast("struct<seq:bigint,name:string,block:bigint>").alias("own")))
    before = F.last(event, ignorenulls=True).over(Window.partitionBy("file").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("_before", before).withColumn("_own", F.when(F.col("part") == BEGUN, begun).when(F.col("_before.open"), F.col("_before.own")))
    joined = pieces.filter("_own is not null").groupBy("file", F.col("_own.seq").alias("seq"), F.col("_own.name").alias("name"), F.col("_own.block").alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_order", "value"))), lambda x: x["value"]), "").alias("value")
    )
    records = parts.filter(F.col("part") == WHOLE).select("file", "block", "seq", "name", "value").unionByName(joined)
    # the name that holds where a range begins: the last one of the ranges before
    known = edges.select("file", "block", "part", F.when(F.col("part") == NAME, F.col("name")).alias("name")).withColumn("_name", F.last("name", ignorenulls=True).over(back))
    blocks = known.groupBy("file", "block").agg(F.max(F.struct("part", "_name"))["_name"].alias("_name"))
    held = starts.select("file", "block", "base").join(blocks, ["file", "block"], "left")
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("file", "block", "base", F.last("_name", ignorenulls=True).over(so_far).alias("_before"))
    out = records.join(F.broadcast(held), ["file", "block"]).filter((F.col("base") == 1) | (F.coalesce("name", "_before") == name))
    return out.select("file", "seq", "value")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, value): the lines of text files; ``seq`` grows with the line's place in its file."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for (_, block), begins, rows in _ranges(batches):
            if begins:
                place = block + (1 if block else 0)
            ends = place + np.cumsum(pc.add(pc.binary_length(rows.column(2)), 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.concatenate([[place], ends[:-1]]), pa.int64()), rows.column(2)], names=["file", "seq", "value"])
            place = int(ends[-1])

    return _fragments(spark, path, "\n").mapInArrow(number, "file string, seq long, value string")
