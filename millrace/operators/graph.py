"""Multi-source personalised PageRank, in linear space.

Edges stay where they are, partitioned by source node and written once; an iteration moves ranks only. What doesn't arrive
(mass of dangling nodes, or sent to nodes without a record) goes back to its own source. Ranks that are zero have no row
until the result is filled up. Each iteration is written to the shared folder, so an executor's loss costs no recomputation,
and the next can start from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

ALPHA = 0.15


def records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, outdeg, indeg, least, greatest): each node's record, its neighbours told by count, least and greatest."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outdeg"), F.min("dst").alias("least"), F.max("dst").alias("greatest"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("indeg"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select(F.col("id").alias("node")).join(out, "node", "left").join(into, "node", "left").select("node", zero("outdeg"), zero("indeg"), "least", "greatest")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, active, dangling): one row of counts."""
    per = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    return per.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.count("n").alias("active"), F.count_if(F.col("n").isNull()).alias("dangling"))


def initial(nodes: DataFrame, sources: Sequence[int]) -> DataFrame:
    """(source, id, p): all mass on the source itself, if it is a node. Of a repeated source only the first has mass."""
    own = F.array(*(F.lit(int(s)).cast("long") for s in dict.fromkeys(sources)))
    return nodes.select("id").where(F.array_contains(own, F.col("id"))).distinct().select(F.col("id").alias("source"), "id", F.lit(1.0).alias("p"))


def prepared(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, deg) with deg counting all of a node's edges, of which those to nodes without a record are then dropped."""
    if nodes.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a node has more than one record")
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    e = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept(e.join(deg, "src").select("src", "dst", "deg").repartition("src"))


def step(ranks: DataFrame, edges: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(source, id, p) after one iteration."""
    into = ranks.join(edges, ranks["id"] == edges["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum(F.col("p") / F.col("deg")).alias("p"))
    # what each source keeps: the mass of nodes, less the part that edges to nodes with a record carry on
    jump = into.groupBy("source").agg(F.sum("p").alias("arrived"))
    sources = ranks.select("source").distinct()
    back = sources.join(jump, "source", "left").select("source", F.col("source").alias("id"), (F.lit(alpha) + F.lit(1 - alpha) * F.greatest(F.lit(0.0), 1 - F.coalesce("arrived", F.lit(0.0)))).alias("p"))
    moved = into.select("source", "id", (F.lit(1 - alpha) * F.col("p")).alias("p"))
    return moved.union(back).groupBy("source", "id").agg(F.sum("p").alias("p"))


def pagerank(nodes: DataFrame, edges: DataFrame, sources: Sequence[int], iterations: int, alpha: float = ALPHA, ranks: DataFrame | None = None) -> DataFrame:
    """(source, id, p) after `iterations`, rows with mass only. ranks: the state to start from. nodes: (id); edges: (src, dst).

    Edges are a multigraph: a repeated edge counts twice. No nodes or no source among them: no rows.
    """
    e = prepared(nodes, edges)
    ranks = initial(nodes, sources) if ranks is None else ranks
    for _ in range(iterations):
        ranks = kept(step(ranks, e, alpha))
    return ranks


def filled(ranks: DataFrame, nodes: DataFrame, sources: Sequence[int]) -> DataFrame:
    """(source, id, p) with a row for each source and node, zero where there is no mass. A repeated source has rows for each time it
    is given: the first time its mass, later zero everywhere."""
    told = [F.struct(F.lit(int(s)).cast("long").alias("source"), F.lit(s in sources[:i]).alias("again")) for i, s in enumerate(sources)]
    each = nodes.select("id", F.inline(F.array(*told)))
    return each.join(ranks, ["source", "id"], "left").select("source", "id", F.when(F.col("again"), 0.0).otherwise(F.coalesce("p", F.lit(0.0))).alias("p"))


def top(ranks: DataFrame, k: int = 10, digits: int = 8) -> DataFrame:
    """(source, rank, id, p): each source's k nodes of highest rank, compared to `digits`, ties to the lesser node."""
    r = ranks.withColumn("p", F.round("p", digits))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("p"), "id"))).where(F.col("rank") <= k).select("source", "rank", "id", "p")


def report(topped: DataFrame) -> DataFrame:
    """(source, rank, line): `%.5f node` as the report writes it."""
    return topped.select("source", "rank", F.format_string("%.5f %d", "p", "id").alias("line"))


def next_user(events: DataFrame) -> DataFrame:
    """(user_id, event_type, following): the user of the next event of the same type, null for the last one.

    By a window within (type, day); a day's last event gets the first of the type's next day, found from one row a day.
    """
    at = F.struct("ts", "event_id", "user_id")
    e = events.select("ts", "event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    inner = e.withColumn("inside", F.lead("user_id").over(Window.partitionBy("event_type", "day").orderBy("ts", "event_id")))
    days = e.groupBy("event_type", "day").agg(F.min(at).alias("first"))
    days = days.select("event_type", "day", F.lead("first.user_id").over(Window.partitionBy("event_type").orderBy("day")).alias("after"))
    return inner.join(days, ["event_type", "day"]).select("user_id", "event_type", F.coalesce("inside", "after").alias("following"))


def transitions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an event table: a user leads to the next user of the same kind of event, and to a dangling node of the
    kind, numbered by its initial with a minus sign. Distinct edges."""
    both = F.array("following", -F.ascii("event_type").cast("long"))
    e = kept(next_user(events).select(F.col("user_id").alias("src"), F.explode(both).alias("dst")).where("dst is not null").distinct())
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes, e
