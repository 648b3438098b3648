"""Mixing sources to target weights by capped water-filling.

Each source's target is min(cap, level * weight), where cap is `epochs` times its size and the one level makes the
targets sum to the mix. Sources are clamped at their caps and the excess is reshared by weight until no more are above;
each round is one sum over the table of sources, so no task holds all of them.

A source's documents are then repeated: floor(target / size) whole times each, and once more in a seeded order until the
target is reached; the document at the boundary gives the fractional repetition, its first words. So each source's taken
words are its target to within a word, and no document exceeds `epochs` times its size. The seeded order is cut by
buckets: sums per (source, bucket) find the bucket in which the target falls, and only that bucket's documents, a 4096th
of a source, are sorted. A source that holds a third of all rows so needs no task of its own.

Nulls and edges: a null text has size 0 and takes 0; a null source is a source of its own, after all others. Empty
tables give empty results. Rows of the same doc_id and size are interchangeable. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, n_spaced, packed, unpacked

BUCKETS_HEX = 3
#: Rows of the table of targets up to which it is broadcast: under 10 MB. Beyond, the join shuffles and AQE splits its skew.
BROADCAST_ROWS = 100_000


def ranked(sources: DataFrame) -> DataFrame:
    """sources, a row each, with `rank`, their place from 0 by code point, null last. The sort is spread over the tasks; what
    goes through one window is a row for each task."""
    s = kept(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    # such an id is the part's number, then the row's place in it
    s = s.select("*", F.shiftright("at", 33).alias("part"))
    parts = s.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return s.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at") - F.shiftleft("part", 33)).select(*sources.columns, "rank")


def water_level(sources: DataFrame, share: float) -> float | None:
    """The level at which the targets of sources (source_size, cap, weight) sum to the mix; None if no cap is out of reach.

    Round by round, sources whose cap is below the level are clamped and the excess is reshared by weight, which raises the level.
    This is Newton's iteration on a concave piecewise linear function: each round at least quarters the product of the
    excess and the weights it is shared by, so the rounds grow with the logarithm of the sizes, not with the sources.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).head()
    if not weights:
        return None
    total, clamped = share * float(total), 0
    level = total / weights
    while True:
        over = F.col("cap") / F.col("weight") < F.lit(level)
        caps, weights, now = sources.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).head()
        if now == clamped:
            return level
        if not weights:
            return None
        level, clamped = (total - caps) / weights, now


def targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; weights, all above 0, repeat over the sources by code point, null last."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    s = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    level = water_level(s, share)
    return s.select("source", "source_size", (F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))).alias("target"))


def order_key(seed: int) -> Column:
    """The seeded order of documents."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, source, text)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_spaced("text").alias("size")).withColumn("key", order_key(seed)).withColumn("bucket", F.substring("key", 1, BUCKETS_HEX))
    rows = kept(rows)
    by_bucket = kept(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    goal = targets(by_bucket, weights, share, epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = by_bucket.withColumn("upto", F.sum("size").over(run))
    g = goal.alias("g")
    cut = sums.alias("b").join(g, F.col("b.source").eqNullSafe(F.col("g.source")))
    # the bucket in which the rest falls, and the rest left for it
    cut = cut.where(F.col("upto") > F.col("rest")).groupBy(F.col("g.source").alias("source")).agg(F.min(F.struct(F.col("bucket"), (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))).alias("cut"))
    goal = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.*", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.left").alias("cut_left"))
    goal = kept(goal)
    small = F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal
    r = rows.alias("r").join(small.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", "source_size", "target", "whole", "cut_bucket", "cut_left")
    at = F.col("bucket") == F.col("cut_bucket")
    clear = r.where(F.col("cut_bucket").isNull() | ~at).withColumn("extra", F.when(F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")), F.col("size")).otherwise(F.lit(0)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = r.where(at).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_left") - before)))
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "key")


def copies(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """docs repeated as mixed: whole copies, then the first words of the fractional one. Copies keep all columns of docs.

    A document without words stays once. Rows of the same doc_id, source and size are interchangeable: what they take
    together is dealt out evenly among them, to within a word.
    """
    key = [F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k_id"), F.coalesce("source", F.lit("")).alias("k_source"), F.col("source").isNull().alias("k_null"), F.col("size").alias("k_size")]
    keys = ["k_id", "k_source", "k_null", "k_size"]
    shares = taken.select(*key, "taken").groupBy(*keys).agg(F.sum("taken").alias("sum"), F.count("*").alias("rows"))
    d = packed(docs).withColumn("n", n_spaced("d.text"))
    d = d.withColumns({"k_id": F.coalesce(F.col("d.doc_id").cast("long"), F.lit(-(2**63))), "k_source": F.coalesce(F.col("d.source").cast("string"), F.lit("")), "k_null": F.col("d.source").isNull(), "k_size": F.col("n")})
    d = d.join(shares.hint("shuffle_hash"), keys).withColumn("own", F.round(F.col("sum") / F.col("rows")).cast("long"))
    whole, part = F.floor(F.col("own") / F.greatest("n", F.lit(1))).cast("int"), (F.col("own") % F.greatest("n", F.lit(1))).cast("int")
    none = F.array().cast("array<int>")
    lengths = F.when(F.col("n") == 0, F.array(F.lit(0))).otherwise(F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(none)))
    d = d.select("d", F.explode(lengths).alias("part"))
    words = F.regexp_extract_all("d.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    d = d.withColumn("new", F.when(F.col("part") > 0, F.array_join(F.slice(words, 1, F.col("part")), "")).otherwise(F.col("d.text")))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("part") > 0, F.length("new")).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*unpacked(docs.columns, changed))


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
keyed AS (SELECT *, md5('17:' || coalesce(doc_id::varchar, '-') || ':' || size) AS key FROM rows),
sums AS (SELECT source, sum(size)::bigint AS source_size FROM rows GROUP BY source),
weighed AS (SELECT source, source_size, 2.0::double * source_size AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS weight FROM sums),
levels AS (SELECT *, ((SELECT 1.5::double * sum(source_size) FROM sums) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goal AS (SELECT source, source_size, least(cap, (SELECT level FROM levels WHERE cap / weight >= level ORDER BY cap / weight, level LIMIT 1) * weight) AS target FROM levels),
goals AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS whole FROM goal),
run AS (SELECT k.*, g.source_size, g.target, g.whole, round(g.target - g.whole * g.source_size)::bigint AS rest,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target::double AS target, (whole * size + greatest(0, least(size, rest - before)))::bigint AS taken FROM run"""
