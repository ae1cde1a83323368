"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

The mix is counted in blocks of ``block_words`` words. Blocks are apportioned to sources by
the highest quotients ``target / (2 * seats + 1)``, and each source's blocks to its shards in
the same way. Inside a shard the documents stand in a seeded order and the quota takes the
first blocks of that order, going round once more when the quota exceeds the shard.
What is done in one place, by window, has a row a source, or the rows of one shard.

Defined results: a null text has size 0; a null source is one source of its own, sorted last;
an empty table gives no rows; repeated rows are separate documents (equal rows are
interchangeable, so reruns agree); rows without a doc_id are spread by their texts; extra columns
are ignored by ``mix``, and ``mix_rows`` replaces columns named size and taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.llm.spark import cut

WORD = r"[^\x20\x09-\x0D]+"
#: The weights that sources get in turn, in code point order.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 8
SHARD_WORDS = 1 << 19
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, weight, target: weighted shares, capped at ``epochs`` times the source.

    A capped source's excess goes to the others by weight until none is above its cap. Sorted
    by cap/weight, the capped sources are a prefix, so running sums find the level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on, so the unpartitioned windows see a dimension, not the corpus
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = by_source.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    w = w.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("ratio"))
    w = w.withColumn("rest_level", F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    return w.select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("rest_level")).alias("target"),
    )


def apportion(parts: DataFrame, group: list[str], order: list[Column], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: add ``quota`` so that each group's ``seats`` go to the highest quotients.

    Rounding ``votes`` at a divisor a little too large gives each part no more than its final
    number, and at one a little too small no less; what lies between is at most two quotients
    a part, and only these are ranked.
    """
    of_group = Window.partitionBy(*group)
    p = (
        parts.withColumn("_n", F.count(F.lit(1)).over(of_group))
        .withColumn("_votes", F.sum(F.col(votes).cast("double")).over(of_group))
        .withColumn("_seats", F.col(seats).cast("double"))
    )
    half = F.col("_n") / 2
    low = F.when(F.col("_seats") > half, F.col("_seats") - half).otherwise(F.lit(0.0))
    rounded = lambda seats_: F.when(F.col("_votes") > 0, F.floor(F.col(votes) * seats_ / F.col("_votes") + 0.5)).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("_base", rounded(low)).withColumn("_top", F.greatest(rounded(F.col("_seats") + half), "_base") + 1)
    p = p.withColumn("_key", F.row_number().over(of_group.orderBy(*order)))
    left = F.col(seats) - F.sum("_base").over(of_group)
    p = p.withColumn("_left", left)
    quotient = F.col(votes) / (2 * F.col("_seat") + 1)
    ranked = (
        p.select(*group, "_key", "_left", F.col(votes), F.explode(F.sequence("_base", "_top")).alias("_seat"))
        .withColumn("_rank", F.row_number().over(of_group.orderBy(quotient.desc(), "_key", "_seat")))
        .filter(F.col("_rank") <= F.col("_left"))
        .groupBy(*group, "_key")
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group] + [F.col("p._key") == F.col("r._key")]
    joined = p.alias("p").join(ranked.alias("r"), on=same, how="left")
    return joined.select(*[F.col(f"p.{c}") for c in parts.columns], (F.col("p._base") + F.coalesce(F.col("r._more"), F.lit(0))).alias("quota"))


def place_of(doc_id: Column, text: Column, seed: str) -> Column:
    """A digest that orders rows; the text is part of it, so rows of one doc_id, or of none, are spread too."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def _groups(documents: DataFrame, block_words: int, shard_words: int, seed: str) -> DataFrame:
    """One row for the ``n`` rows of one doc_id, source and text: what the mix takes of them, as

    ``rounds`` times each and then ``rest`` words of the first of them, besides source_size, target,
    shard and quota.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select("doc_id", "source", size.alias("size"), place_of(F.col("doc_id"), F.col("text"), seed).alias("place"))
    # equal rows meet before any of them is placed, so a text that came a great many times is one row
    sizes = cut(rows.groupBy("doc_id", "source", "size", "place").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")))
    one = Window.partitionBy()
    blocks = F.floor(F.sum("target").over(one) / block_words + 0.5).cast("long")
    targets = apportion(targets.withColumn("blocks", blocks), [], [F.col("source").asc_nulls_last()], "target", "blocks").withColumnRenamed("quota", "source_quota")
    targets = targets.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
    t = targets.alias("t")
    # as many rows as sources; Spark broadcasts them by their measured size or else splits the hot source
    placed = sizes.alias("d").join(t, F.col("d.source").eqNullSafe(F.col("t.source")), "inner").select(
        "d.doc_id", "d.source", "d.size", "d.place", "d.n", "t.source_size", "t.target", "t.source_quota",
        F.pmod(F.conv(F.substring("d.place", 1, 8), 16, 10).cast("long"), F.col("t.shards")).alias("shard"),
    )
    shards = placed.groupBy("source", "shard", "source_quota").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"))
    shards = apportion(shards, ["source"], [F.col("shard")], "shard_size", "source_quota")
    s = shards.alias("s")
    placed = placed.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard")), "inner").select(
        "d.*", "s.shard_size", "s.quota"
    )
    # texts without words have no place in the order, however many there are
    some, none = placed.filter("size > 0"), placed.filter("size = 0")
    order = Window.partitionBy("source", "shard").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("before", F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n"))
    placed = some.unionByName(none.withColumn("before", F.lit(0).cast("long")))
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * EPOCHS)
    rounds = F.when(F.col("shard_size") > 0, F.expr(f"least(quota * {block_words}, shard_size * {EPOCHS}) div shard_size")).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size") * F.col("n"), words - rounds * F.col("shard_size") - F.col("before")))
    return placed.select("doc_id", "source", "size", "place", "n", "source_size", "target", "shard", "quota", rounds.cast("long").alias("rounds"), rest.cast("long").alias("rest"))


def mix_rows(documents: DataFrame, seed: str = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``documents`` with size and taken, which replace columns of these names.

    Texts stay where they are but for one join. Rows equal in doc_id, source and text share what
    they are taken for as evenly as whole words allow.
    """
    taken = _groups(documents, block_words, shard_words, seed)
    per_row = F.col("rounds") * F.col("size") + F.expr("rest div n")
    t = taken.select(F.col("place").alias("_p"), F.col("source").alias("_s"), "size", per_row.alias("taken")).alias("t")
    d = documents.alias("d")
    same = (place_of(F.col("d.doc_id"), F.col("d.text"), seed) == F.col("t._p")) & F.col("d.source").eqNullSafe(F.col("t._s"))
    return d.join(t, same).select(*[F.col(f"d.`{c}`") for c in documents.columns if c not in ("size", "taken")], "t.size", "t.taken")


#: Equal rows that one task writes out at a time.
AT_ONCE = 10_000


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, source, shard, quota."""
    g = _groups(documents, block_words, shard_words, seed)
    few = g.filter(F.col("n") <= AT_ONCE).withColumn("_j", F.explode(F.expr("sequence(0L, n - 1)")))
    many = g.filter(F.col("n") > AT_ONCE).withColumn("_k", F.explode(F.expr(f"sequence(0L, (n - 1) div {AT_ONCE})"))).repartition("place", "_k")
    many = many.withColumn("_j", F.explode(F.expr(f"sequence(_k * {AT_ONCE}, least(n, (_k + 1) * {AT_ONCE}) - 1)"))).drop("_k")
    # of equal rows the first ones are taken once more
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_j") * F.col("size")))
    taken = (F.col("rounds") * F.col("size") + part).cast("long")
    return few.unionByName(many).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard", "quota")


def oracle() -> str:
    """DuckDB SQL of the mix: every quotient of every source and shard is written out and the highest are taken."""
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    before = "ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest FROM documents),
sources AS (SELECT source, sum(size) AS source_size, CAST({weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
leveled AS (SELECT *, source_size * {float(EPOCHS)}::DOUBLE / weight AS ratio, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(source_size * {float(EPOCHS)}::DOUBLE) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM (SELECT *, source_size * {float(EPOCHS)}::DOUBLE / weight AS ratio FROM sources) WINDOW before AS ({before})),
targets AS MATERIALIZED (SELECT source, source_size, place, CASE WHEN level >= ratio THEN source_size * {float(EPOCHS)}::DOUBLE ELSE weight * (SELECT arg_min(level, {{'r': ratio, 'p': place}}) FROM leveled WHERE level < ratio) END AS target FROM leveled),
blocks AS (SELECT CAST(floor(sum(target) / {BLOCK_WORDS} + 0.5) AS BIGINT) AS n FROM targets),
seats AS (SELECT source, place, target / (2 * s + 1) AS quotient, s FROM (SELECT source, place, target, unnest(range(0, CAST((SELECT n FROM blocks) AS BIGINT))) AS s FROM targets)),
quotas AS (SELECT t.source, t.source_size, t.target, coalesce(q.k, 0) AS quota FROM targets t LEFT JOIN (SELECT place, count(*) AS k FROM (SELECT place, row_number() OVER (ORDER BY quotient DESC, place, s) AS rank FROM seats) WHERE rank <= (SELECT n FROM blocks) GROUP BY place) q ON t.place = q.place),
placed AS MATERIALIZED (SELECT d.*, q.source_size, q.target, q.quota AS source_quota, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % CAST(greatest(ceil(source_size / {SHARD_WORDS}.0::DOUBLE), 1) AS BIGINT) AS shard FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
shards AS MATERIALIZED (SELECT source, shard, source_quota, sum(size) AS shard_size FROM placed GROUP BY ALL),
shard_seats AS (SELECT source, shard, source_quota, shard_size / (2 * s + 1)::DOUBLE AS quotient, s FROM (SELECT *, unnest(range(0, source_quota)) AS s FROM shards)),
shard_quotas AS (SELECT source, shard, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, s) AS rank FROM shard_seats) WHERE rank <= source_quota GROUP BY ALL),
final AS (SELECT p.*, s.shard_size, least(coalesce(k, 0) * {BLOCK_WORDS}, s.shard_size * {EPOCHS}) AS words, sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY p.digest, p.size ROWS UNBOUNDED PRECEDING) - p.size AS before
  FROM placed p JOIN shards s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard LEFT JOIN shard_quotas q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(CASE WHEN shard_size = 0 THEN 0 ELSE words // shard_size * size + greatest(0, least(size, words % shard_size - before)) END AS BIGINT) AS taken FROM final"""
