"""Merkle dataset manifest: a digest for each row, a root over all, and a proof for each row.

Rows are leaves in the order of their ids, in a tree for each source; the roots of the sources, in
the order of their names, are the leaves of one tree more. While several nodes remain, each run of
16 becomes the digest of its digests.

The trees are worked by time-forward processing. A node's label is the last position that it can
cover, then its height, so children come before parents. The sweep goes through leaves in order; a
node sends its digest to its parent through a priority queue ordered by label, and a parent is due
as soon as the sweep has passed its label. Between tasks Spark's sorted shuffle is the queue: a
block of 16 ** HEIGHT positions is swept by one task, its top node is a leaf of the next sweep, and
so on until one node of each tree is left. The reversed sweeps then go from the top down: each node
sends its children what their proofs end with, between tasks as one row for each block.

Defined results: null fields are written as '-'; a null id comes before others and is never changed
by ``lower_case_some``; a null source is a source of its own, before others; rows of one source and
id follow the order of their digests, and wholly equal rows are leaves of equal digest; a lone
leaf is its source's root; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellpath.llm.spark import shuffle_width, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests to a run; levels that one task sweeps.
RUN, HEIGHT = 16, 3
BLOCK = RUN**HEIGHT
_BITS = 4
_ROWS = 4096


def digest_text(*fields: Column) -> Column:
    """What is hashed of a row: each field's length in bytes and its value, or '-'."""
    written = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in written])


def lower_case_some(key: str = "doc_id", text: str = "text", one_in: int = 5) -> Column:
    """The text with A-Z lower-cased in the rows whose id's checksum the number divides; null in other rows."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % one_in == 0, F.translate(text, upper, upper.lower()))


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------ positions

def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order with the range's number, their place in their tree here, and whether it is the range's first tree."""
    part = TaskContext.get().partitionId()
    tree, n, trees = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(0))
        ends, values = runs.run_ends.to_numpy(), runs.values.to_pylist()
        nth, first, at = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool), 0
        for end, value in zip(ends.tolist(), values, strict=True):
            if not trees or value != tree:
                tree, n, trees = value, 0, trees + 1
            nth[at:end] = np.arange(n, n + end - at)
            first[at:end] = trees == 1
            n, at = n + end - at, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(nth), part, np.int32)), pa.array(nth), pa.array(first)], names=[*batch.schema.names, "part", "nth", "first"])


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place within ``tree`` (the first column) by the order, from 0.

    Rows are dealt out by ranges; only a range's first tree can have begun in an earlier one, so a
    count for each range is all that ranges tell each other.
    """
    spark = rows.sparkSession
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by)
    numbered = stored(dealt.mapInArrow(_number, f"{schema}, part int, nth long, first boolean"))
    ranges = numbered.groupBy("part").agg(F.min(F.struct("tree")).alias("a"), F.max(F.struct("tree", "nth")).alias("z"), F.count_if("first").alias("n"), F.bool_and("first").alias("one")).orderBy("part").collect()
    starts, tree, count = [], None, None
    for r in ranges:
        start = count if count is not None and r["a"]["tree"] == tree else 0
        starts.append((r["part"], start))
        tree, count = r["z"]["tree"], start + r["n"] if r["one"] else r["z"]["nth"] + 1
    starts = spark.createDataFrame(starts, "part int, start long")
    out = numbered.join(F.broadcast(starts), "part")
    return out.withColumn("pos", F.col("nth") + F.when(F.col("first"), F.col("start")).otherwise(0)).drop("part", "nth", "first", "start")


# ------------------------------------------------------------------ sweeps

def _label(pos: int, height: int) -> int:
    """The last position that the node of this height over ``pos`` can cover."""
    return pos | ((1 << _BITS * height) - 1)


class Rising:
    """The sweep of one block; positions count from the block's first."""

    def __init__(self, first: bool):
        self.first, self.n = first, 0
        self.queue: list[tuple[int, int, int, str]] = []

    def send(self, pos: int, height: int, digest: str) -> None:
        """Deliver a node's digest to its parent; the slot keeps a parent's children in order."""
        heapq.heappush(self.queue, (_label(pos, height + 1), height + 1, pos, digest))

    def settle(self) -> None:
        """Evaluate the node whose label comes first."""
        label, height = self.queue[0][:2]
        children = []
        while self.queue and self.queue[0][:2] == (label, height):
            children.append(heapq.heappop(self.queue)[3])
        self.send(label, height, _hash(children))

    def leaf(self, digest: str) -> None:
        while self.queue and self.queue[0][0] < self.n:
            self.settle()
        self.send(self.n, 0, digest)
        self.n += 1

    def top(self) -> str:
        """The block's one node. A tree's first block may be all of it and ends where one node is left; others go to the full height."""
        while self.queue[0][1] <= HEIGHT and (not self.first or self.n > RUN ** (self.queue[0][1] - 1)):
            self.settle()
        return self.queue[0][3]


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, sweep, out = None, None, []
    for batch in batches:
        for tree, pos, digest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if at != (tree, pos // BLOCK):
                if sweep:
                    out.append((*at, bytes.fromhex(sweep.top())))
                at = (tree, pos // BLOCK)
                sweep = Rising(at[1] == 0)
            sweep.leaf(digest.hex())
        if len(out) > _ROWS:
            yield _tops(out)
            out = []
    if sweep:
        out.append((*at, bytes.fromhex(sweep.top())))
    yield _tops(out)


def _tops(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["tree", "pos", "digest"])


def _by_block(nodes: DataFrame) -> DataFrame:
    block = F.expr(f"pos div {BLOCK}")
    return nodes.repartition(shuffle_width(nodes.sparkSession), "tree", block).sortWithinPartitions("tree", "pos")


def rise(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, pos, digest), the tops of their blocks, and so on; the last has one node for each tree."""
    levels = [nodes]
    while (levels[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        levels.append(stored(_by_block(levels[-1].select("tree", "pos", "digest")).mapInArrow(_rise, "tree string, pos long, digest binary"), share=8))
    return levels


def falling(digests: list[str], first: bool, ending: tuple) -> Iterator[tuple[int, tuple]]:
    """(place, ending) of a block's nodes, by descending place.

    An ending is a chain (left, right, ending of the parent): the digests left and right of a node
    in its run, then the parent's; the chain of a root is empty. The labels are those of the sweep up, in reversed order.
    """
    levels = [digests]
    while len(levels[-1]) > 1 if first else len(levels) <= HEIGHT:
        low = levels[-1]
        levels.append([_hash(low[k : k + RUN]) for k in range(0, len(low), RUN)])
    top = len(levels) - 1
    queue = [(-_label(0, top), -top, 0, ending)]
    while queue:
        _, height, k, ending = heapq.heappop(queue)
        if not height:
            yield k, ending
            continue
        height = -height - 1
        run = levels[height][k * RUN : (k + 1) * RUN]
        for j in range(len(run)):
            child = k * RUN + j
            heapq.heappush(queue, (-_label(child << _BITS * height, height), -height, child, ("".join(run[:j]), "".join(run[j + 1 :]), ending)))


def _chain(lefts: list[str], rights: list[str]) -> tuple:
    """Levels from the lowest up as a chain."""
    out: tuple = ()
    for left, right in zip(reversed(lefts), reversed(rights), strict=True):
        out = (left, right, out)
    return out


def _levels(chain: tuple) -> Iterator[tuple[str, str]]:
    while chain:
        yield chain[:2]
        chain = chain[2]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, list[dict]]]:
    """((tree, block), the message to the block, its rows) of rows sorted by tree, block and place; the message has no place."""
    message, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["nth"] is None:
                if rows:
                    yield (message["tree"], message["block"]), message, rows
                message, rows = r, []
            else:
                rows.append(r)
    if rows:
        yield (message["tree"], message["block"]), message, rows


def _fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages to the blocks below."""
    for (tree, block), message, rows in _blocks(batches):
        out = [(tree, block * BLOCK + k, *zip(*_levels(e), strict=True)) if e else (tree, block * BLOCK + k, (), ()) for k, e in falling([r["digest"].hex() for r in rows], block == 0, _chain(message["lefts"], message["rights"]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), *[pa.array([list(r[k]) for r in out], pa.list_(pa.string())) for k in (2, 3)], pa.array([message["subroot"]] * len(out), pa.string()), pa.array([message["root"]] * len(out), pa.string())],
            names=["tree", "block", "lefts", "rights", "subroot", "root"],
        )


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of the leaves: the siblings' digest, and the root folded from the offered leaf and the siblings."""
    for (_, block), message, rows in _blocks(batches):
        leaves = [r["digest"].hex() for r in rows]
        proofs, folded, lists = [None] * len(rows), [None] * len(rows), [None] * len(rows)
        above: dict[int, str] = {}
        for k, ending in falling(leaves, block == 0, _chain(message["lefts"], message["rights"])):
            digest = rows[k]["offered"].hex() if rows[k]["offered"] is not None else leaves[k]
            own = "".join(ending[:2]) if ending else ""
            if ending and id(ending[2]) not in above:  # the rest of the proof is shared by a run
                above = {id(ending[2]): "".join(x + y for x, y in _levels(ending[2]))}
            proofs[k] = _hash([own, above[id(ending[2])]] if ending else [])
            for left, right in _levels(ending):
                digest = _hash([left, digest, right])
            folded[k] = digest
            lists[k] = [x[j : j + 64] for pair in _levels(ending) for x in pair for j in range(0, len(x), 64)] if message["siblings"] else None
        same = lambda c: pa.array([message[c]] * len(rows), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["key"] for r in rows], pa.int64()), pa.array(leaves), same("subroot"), same("root"), pa.array(proofs), pa.array(folded), pa.array([f == message["root"] for f in folded]), pa.array(lists, pa.list_(pa.string()))],
            names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"],
        )


def _with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes of each block after the message to it."""
    n = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("nth", F.expr(f"pos % {BLOCK}")).drop("pos")
    both = n.unionByName(messages, allowMissingColumns=True)
    return both.repartition(shuffle_width(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", F.col("nth").asc_nulls_first())


_MESSAGE = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"


def fall(levels: list[DataFrame], messages: DataFrame) -> DataFrame:
    """The messages to the blocks of the lowest level, from those to the blocks of the highest but one."""
    for nodes in reversed(levels[1:-1]):
        messages = stored(_with_messages(nodes, messages).mapInArrow(_fall, _MESSAGE), share=8)
    return messages


# ------------------------------------------------------------------ the operator

def manifest(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, source: str = "source", key: str = "doc_id", offered: Column | None = None, siblings: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    ``offered``: the text that a row is to be verified with, or null for its own; it takes the
    place of the last of ``columns``. With ``siblings`` each row has the digests of its proof too.
    """
    fields = [F.col(c) for c in columns]
    binary = lambda *f: F.unhex(F.sha2(digest_text(*f), 256))
    other = F.when(offered.isNotNull(), binary(*fields[:-1], offered)) if offered is not None else F.lit(None).cast("binary")
    # the number tells equal rows apart, so that ranges can part them; which of them comes first changes nothing
    leaves = stored(documents.select(F.col(source).alias("tree"), F.col(key).alias("key"), binary(*fields).alias("digest"), other.alias("offered"), F.monotonically_increasing_id().alias("nr")))
    nodes = positions(leaves, "key", "digest", "nr").drop("nr")
    levels = rise(nodes)
    subroots = levels[-1].select("tree", "digest")
    sources = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    upper = rise(sources)
    root = F.lower(F.hex("digest"))
    none = F.array().cast("array<string>")
    top = upper[-1].select("tree", F.lit(0).cast("long").alias("block"), none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), root.alias("root"))
    named = sources.select("pos", F.col("name"), root.alias("subroot"))
    if len(upper) == 1:  # one source: its root is the root
        ends = top.withColumn("pos", F.lit(0).cast("long"))
    else:
        ends = stored(_with_messages(upper[0].select("tree", "pos", "digest"), fall(upper, top)).mapInArrow(_fall, _MESSAGE), share=8).withColumnRenamed("block", "pos")
    messages = ends.drop("tree", "subroot").join(named, "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "lefts", "rights", "subroot", "root")
    if len(levels) > 1:
        messages = fall(levels, messages)
    rows = _with_messages(nodes, messages.withColumn("siblings", F.lit(siblings)))
    schema = f"key {dict(documents.dtypes)[key]}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>"
    out = rows.mapInArrow(_prove, schema).withColumnRenamed("key", key)
    return out if siblings else out.drop("siblings")


def tampered(documents: DataFrame) -> DataFrame:
    """The manifest, verified with texts of which one in five is lower-cased."""
    return manifest(documents, offered=lower_case_some())


# ------------------------------------------------------------------ SQL

#: Levels that the SQL goes up: enough for 16 million documents a source and for 65,536 sources.
SQL_LEVELS, SQL_SOURCE_LEVELS = 6, 4


def oracle() -> str:
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    text = lambda last: " || ".join(field(f"CAST({c} AS VARCHAR)") for c in (*COLUMNS[:-1], last))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    steps = [
        f"docs AS (SELECT *, row_number() OVER () AS rid, sha256({text('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({text(lower)}) END AS other FROM documents)",
        "n0 AS (SELECT rid, source AS s, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i FROM docs)",
    ]

    def up(name: str, levels: int) -> None:
        for k in range(levels):
            run = f"PARTITION BY s, i // {RUN} ORDER BY i"
            side = lambda rows: f"coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN {rows}), '')"  # noqa: B023, E731
            steps.append(f"{name}s{k} AS (SELECT s, i, h, count(*) OVER (PARTITION BY s) AS c, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS z FROM {name}{k})")
            steps.append(f"{name}{k + 1} AS (SELECT s, i // {RUN} AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}s{k} GROUP BY s, i // {RUN})")

    up("n", SQL_LEVELS)
    steps.append(f"r0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, h, s AS name FROM n{SQL_LEVELS})")
    up("r", SQL_SOURCE_LEVELS)
    steps.append("f0 AS (SELECT d.doc_id, d.leaf, n.s, n.i, r.i AS j, r.h AS subroot, coalesce(d.other, d.leaf) AS f, '' AS p FROM docs d JOIN n0 n ON d.rid = n.rid JOIN r0 r ON r.name IS NOT DISTINCT FROM n.s)")
    for k in range(SQL_LEVELS + SQL_SOURCE_LEVELS):
        own = k < SQL_LEVELS
        t, h = (f"ns{k}", k) if own else (f"rs{k - SQL_LEVELS}", k - SQL_LEVELS)
        on = f"t.s IS NOT DISTINCT FROM f.s AND t.i = f.i // {RUN**h}" if own else f"t.i = f.j // {RUN**h}"
        steps.append(f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN t.c > 1 THEN sha256(t.a || f.f || t.z) ELSE f.f END AS f, f.p || t.a || t.z AS p) FROM f{k} f JOIN {t} t ON {on})")
    last = f"f{SQL_LEVELS + SQL_SOURCE_LEVELS}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM {last}, r{SQL_SOURCE_LEVELS} r"
