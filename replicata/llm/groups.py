"""Problem 2: splits that keep related records together.

Connected components by alternating large-star and small-star steps over edges between records that share an entity;
the component's identifier is hashed into the ranges that the wanted shares cut from [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.functions.keys import hash60
from replicata.plans.skew import HEAVY_ROWS, join_per_key
from replicata.plans.storage import materialize, release


def shared_entity_edges(records: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Edges ``(u, v)``, u > v, from each record to the smallest record of each of its entities.

    ``records``: ``node, entity``.  An entity of any size gives one edge per record, never all pairs; its smallest record
    comes from a partial aggregate, and its records are dealt to several tasks beyond ``heavy_rows``.
    """
    pairs = materialize(records.filter("node is not null and entity is not null").select("node", "entity").distinct())
    least = materialize(pairs.groupBy("entity").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1"))
    return join_per_key(pairs, least, ["entity"], "n", heavy_rows).filter("node > v").select(F.col("node").alias("u"), "v").distinct()


def _large_star(e: DataFrame, heavy_rows: int, edges: int) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest in u's neighbourhood, u included."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "w").alias("m"), "n")
    return join_per_key(both.filter("v > u"), least, ["u"], "n", heavy_rows, edges).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, heavy_rows: int, edges: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = join_per_key(e, least, ["u"], "n", heavy_rows, edges).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u, v`` with u > v); the component is its smallest node.

    A node with more than ``heavy_rows`` edges is dealt to several tasks.  Each round writes its edges to the shared folder (lost executors cost one round at most) and ends when a round leaves the edges
    as they were, by count and by an order-free 128-bit sum of hashes; every edge then links a node to the smallest of its component.  Null ends
    and loops are ignored; an empty graph has no components.
    """
    e = materialize(edges.filter("u > v").select("u", "v"))
    half = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    seen = e.agg(F.count("*"), half(1), half(2)).first()
    while True:
        large = _large_star(e, heavy_rows, seen[0])  # no step adds edges
        if seen[0] > heavy_rows:
            large = materialize(large)
        nxt = materialize(_small_star(large, heavy_rows, seen[0]))
        release(large)
        now = nxt.agg(F.count("*"), half(1), half(2)).first()
        release(e)
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def related(records: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``node, component`` of the nodes that share entities, directly or through others; the component is its smallest node.

    ``records``: ``node, entity``, of any types, repeated at will; rows with a null in either count for nothing.  Nodes are numbered in their order once, so that the rounds
    shuffle numbers and their least values come from hash aggregates; the smallest number is still the smallest node.
    """
    from replicata.operators.joins import with_ordinal

    pairs = materialize(records.filter("node is not null and entity is not null").select("node", "entity").distinct())
    nodes = materialize(with_ordinal(pairs.select("node").distinct(), "node"))
    edges = shared_entity_edges(pairs.join(nodes, "node").select(F.col("ordinal").alias("node"), "entity"), heavy_rows)
    found = connected_components(edges, heavy_rows).withColumnsRenamed({"node": "n", "component": "c"})
    own, first = nodes.withColumnRenamed("ordinal", "n"), nodes.select(F.col("ordinal").alias("c"), F.col("node").alias("component"))
    return found.join(own, "n").join(first, "c").select("node", "component")


def unit_hash(*c: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return hash60(*c) / F.lit(float(1 << 60))


def split_by_shares(component: Column, train: Column, valid: Column, *salt: Column) -> Column:
    """``train``, ``valid`` or ``test`` by the range of [0, 1) into which the component's hash falls.

    Null shares make a null subset; shares need not add up to 1, the rest goes to test.
    """
    h = unit_hash(component, *salt)
    return F.when(h < train, "train").when(h < train + valid, "valid").when((train + valid).isNotNull(), "test")


def torn_groups(members: DataFrame, components: DataFrame) -> DataFrame:
    """Groups whose rows lie in more than one subset of a split: ``split_uuid, fold, component``.

    ``members``: ``split_uuid, fold, node, subset`` (train, valid, test; others null).  Nodes without a component are groups of
    their own; null nodes and subsets take part in nothing.  Rows shrink to one bit mask per split, fold and node before the join.
    """
    bit = F.when(F.col("subset") == "train", 1).when(F.col("subset") == "valid", 2).otherwise(4)
    masks = members.filter("node is not null and subset is not null").groupBy("split_uuid", "fold", "node").agg(F.bit_or(bit).alias("mask"))
    named = masks.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.groupBy("split_uuid", "fold", "component").agg(F.bit_or("mask").alias("mask")).filter(F.bit_count("mask") > 1).drop("mask")
