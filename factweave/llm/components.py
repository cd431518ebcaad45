"""One group identifier for all records linked directly or indirectly.

The component of the vertex with the most links is peeled first by breadth-first frontier joins: it holds the
hot vertices and most of the rows, and a frontier join touches each of its edges once. A peel that runs into
its round limit is still exact: what it reached is contracted to one vertex and the rest goes on. The
remaining components are labelled by minimum propagation with contraction: in every round each vertex hooks
its larger neighbours to the least neighbour it has (first the larger, then the smaller side), so a chain
halves in a round instead of moving by one link. Every round ends in a table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import saved


def latest_links(pairs: DataFrame, left: str, right: str, verdict: str, at: str, wanted: str) -> DataFrame:
    """Unordered pairs (``a`` < ``b``) of different ids whose latest row has the verdict ``wanted``.

    Case and padding of verdicts don't count. Among rows of the same time the greatest verdict text decides; a null time is
    older than any; rows with a null or equal id, or a null verdict in the latest row, give no link.
    """
    l, r = F.col(left).cast("string"), F.col(right).cast("string")
    said = F.upper(F.regexp_replace(F.col(verdict), r"(?U)^\s+|\s+$", ""))
    rows = pairs.where(l.isNotNull() & r.isNotNull() & (l != r)).select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b"), F.col(at).alias("t"), said.alias("v"))
    # plain maxima keep this a hash aggregation: of all rows, of those that say what is wanted, and of those that come before them in a tie
    is_wanted, before = F.col("v") == wanted, F.col("v") > wanted
    seen = rows.groupBy("a", "b").agg(F.max("t").alias("t"), F.max(F.when(is_wanted, F.col("t"))).alias("tw"), F.max(F.when(before, F.col("t"))).alias("tb"), F.count_if(is_wanted).alias("nw"), F.count_if(before).alias("nb"))
    dated = (F.col("tw") == F.col("t")) & (F.col("tb").isNull() | (F.col("tb") < F.col("t")))
    undated = F.col("t").isNull() & (F.col("nw") > 0) & (F.col("nb") == 0)
    return seen.where(F.coalesce(dated, F.lit(False)) | undated).select("a", "b")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a < b)."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = near.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    small = large.join(down, large["b"] == down["u"]).select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("a").alias("y")), F.struct(F.col("m").alias("x"), F.col("b").alias("y")))).alias("e"))
    return small.where("e.x < e.y").select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and an order-free sum over the edges: equal for two rounds only if nothing moved."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def peel(edges: DataFrame, max_rounds: int) -> tuple[DataFrame | None, DataFrame, int | None]:
    """(the peeled vertices, the edges left, the least peeled vertex if the peel is unfinished or None).

    The neighbours of the first vertex, which may be hot, are found by a filter; no join has its rows under one key. Of an unfinished peel
    all that was reached is one vertex, the least of it.
    """
    near = _both_ways(edges)
    top = near.groupBy("u").count().orderBy(F.desc("count"), "u").first()
    if top is None:
        return None, edges, None
    start = edges.sparkSession.createDataFrame([(top["u"],)], near.select(F.col("u").alias("id")).schema)
    frontier = saved(near.where(F.col("u") == top["u"]).select(F.col("v").alias("id")).distinct())[0]
    others = near.where((F.col("u") != top["u"]) & (F.col("v") != top["u"]))
    seen, done = start.unionByName(frontier), False
    for _ in range(max_rounds - 1):
        reached = others.join(frontier.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        frontier = saved(reached.join(seen, "id", "left_anti"))[0]
        if frontier.isEmpty():
            done = True
            break
        seen = seen.unionByName(frontier)
    if done:
        return seen, edges.join(seen.withColumnRenamed("id", "a"), "a", "left_anti"), None
    mark = seen.select(F.col("id"), F.lit(True).alias("in"))
    rest = edges.join(mark.select(F.col("id").alias("a"), F.col("in").alias("ia")), "a", "left").join(mark.select(F.col("id").alias("b"), F.col("in").alias("ib")), "b", "left")
    hub = seen.agg(F.min("id")).first()[0]
    rest = rest.select(F.when(F.col("ia"), F.lit(hub)).otherwise(F.col("a")).alias("x"), F.when(F.col("ib"), F.lit(hub)).otherwise(F.col("b")).alias("y")).where("x <> y")
    return seen, rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), hub


def numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, id) of every linked record, the links between the ids): ids are hashes of the names, under a seed without collisions."""
    names, _ = saved(links.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    for seed in range(20):
        number = lambda c, s=seed: F.xxhash64(c, F.lit(s))
        ids = names.select("name", number("name").alias("id"))
        if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed gives every record a hash of its own")
    return ids, links.select(F.least(number("a"), number("b")).alias("a"), F.greatest(number("a"), number("b")).alias("b"))


def connected_groups(edges: DataFrame, max_peel_rounds: int = 8, max_rounds: int = 60) -> DataFrame:
    """(id, group_id) of every linked record; group_id is the least id of its group.

    ``edges`` has ids ``a`` and ``b``; direction, repeats, nulls and links to oneself don't count. No edges, no
    rows. Ids compare as strings do. The rounds run on numbers that stand for the ids; every round is a written table that takes the place of the
    one before. Raises if propagation does not settle in ``max_rounds``, which a chain of more links than there are atoms would need.
    """
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    named, _ = saved(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    names, links = numbered(named)
    seen, rest, hub = peel(links, max_peel_rounds)
    if seen is None:
        return named.select(F.col("a").alias("id"), F.col("b").alias("group_id"))  # no rows
    (state, drop), last = saved(rest), None
    for _ in range(max_rounds):
        now = _fingerprint(state)
        if now == last or now[0] == 0:
            break
        last = now
        following = saved(_star_round(state))
        drop()
        state, drop = following
    else:
        raise RuntimeError("minimum propagation did not settle")
    labels = state.select(F.col("b").alias("id"), F.col("a").alias("root"))
    labels = labels.unionByName(state.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
    inside = seen
    if hub is not None:  # an unfinished peel goes on under one vertex
        found = labels.where(F.col("id") == hub).first()
        root = found["root"] if found else hub
        labels = labels.where(F.col("id") != hub)
        inside = labels.where(F.col("root") == root).select("id").unionByName(seen)
        labels = labels.where(F.col("root") != root)
    # the peeled component may hold most rows, so its name is found by itself and no join gathers it under one key
    giant, _ = saved(inside.join(names, "id").select("name"))
    giant = giant.select(F.col("name").alias("id"), F.lit(giant.agg(F.min("name")).first()[0]).alias("group_id"))
    small, _ = saved(labels.join(names, "id").select("name", "root"))
    least = small.groupBy("root").agg(F.min("name").alias("group_id"))
    return small.join(least, "root").select(F.col("name").alias("id"), "group_id").unionByName(giant)
