"""Randomised control graphs and lesions. Draws are orders by a hash of seed and key, so they can be repeated in any engine."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from .graph import degrees

CONTROLS = ("biological", "random_weights", "target_shuffle", "random_erdos", "random_degree_preserving")


def numbered(rows: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """Rows numbered from 1 in an order: sorted by ranges, counted by partition, then offset, so that no task holds all rows. The sorted rows are checkpointed first: a lost executor can't make them be sorted anew."""
    from .reservoir import checkpointed

    held = checkpointed(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()))
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__place"))
    return held.withColumn("__i", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__i") + F.col("__start")).drop("__part", "__place", "__i", "__start")


def permuted(edges: DataFrame, column: str, seed: int) -> DataFrame:
    """Edges with one column's values dealt out anew: the same multiset in another order."""
    here = numbered(edges, ["src", "dst"])
    other = numbered(edges, [draw(seed, F.col("src"), F.col("dst")), "src", "dst"]).select("rn", F.col(column).alias("__v"))
    return here.join(other, "rn").withColumn(column, F.col("__v")).select("src", "dst", "w")


def random_weights(edges: DataFrame, seed: int = 0) -> DataFrame:
    return permuted(edges, "w", seed)


def target_shuffle(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Keeps out-degrees, in-degrees and weights; may make loops and parallel edges."""
    return permuted(edges, "dst", seed)


def random_erdos(edges: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """As many edges between other pairs, without loops or repeats, with the weights in another order.

    Pairs are drawn by number (source and destination from a hash of seed and draw number), a tenth more than needed in
    each round until enough differ, so pairs are never enumerated. No edges give none.
    """
    from .reservoir import checkpointed

    named = checkpointed(numbered(nodes.select("node").distinct(), ["node"], "i"))
    n, m = named.count(), edges.count()
    if m == 0:
        return edges.select("src", "dst", "w")
    if m > n * (n - 1):
        raise ValueError("more edges than pairs of nodes")
    pick = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(n)) + 1
    draws = m + m // 10 + 16
    while True:
        some = edges.sparkSession.range(draws).select("id", pick(1).alias("a"), pick(2).alias("b")).where("a <> b").groupBy("a", "b").agg(F.min("id").alias("id"))
        if some.count() >= m:
            break
        draws *= 2
    chosen = numbered(some, ["id"]).where(F.col("rn") <= m)  # a limit would have each task keep m rows, and one task all of them
    weights = numbered(edges, [draw(seed, F.col("src"), F.col("dst")), "src", "dst"]).select("rn", "w")
    a, b = named.select(F.col("node").alias("src"), F.col("i").alias("a")), named.select(F.col("node").alias("dst"), F.col("i").alias("b"))
    return chosen.join(weights, "rn").join(a, "a").join(b, "b").select("src", "dst", "w")


def degree_preserving(edges: DataFrame, seed: int = 0, rounds: int = 6) -> DataFrame:
    """Both ends' degrees kept, by rounds of swaps: edges are paired by a hash order, (a, b), (c, d) become (a, d), (c, b), unless that
    makes a loop, a present edge, or an edge that another swap of the round makes too. Pairs of a round are disjoint, so a round is one plan of joins."""
    from .reservoir import checkpointed

    now = edges
    for k in range(rounds):
        rows = numbered(now, [draw(seed * 1000 + k, F.col("src"), F.col("dst")), "src", "dst"])
        half = F.floor((F.col("rn") - 1) / 2)
        a = rows.where("rn % 2 = 1").select(half.alias("p"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1"))
        c = rows.where("rn % 2 = 0").select(half.alias("p"), F.col("src").alias("c"), F.col("dst").alias("d"), F.col("w").alias("w2"))
        pairs = checkpointed(a.join(c, "p", "left"))
        swap = pairs.where("c IS NOT NULL AND a <> d AND c <> b AND a <> c AND b <> d")
        made = swap.select("p", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("d").alias("dst")), F.struct(F.col("c").alias("src"), F.col("b").alias("dst")))).alias("e")).select("p", "e.src", "e.dst")
        made = checkpointed(made)
        present = made.join(now.select("src", "dst"), ["src", "dst"], "left_semi").select("p")
        twice = made.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("p").alias("first")).where("n > 1")
        clash = made.join(twice, ["src", "dst"]).where("p <> first").select("p")
        ok = swap.select("p").join(present.unionAll(clash).distinct(), "p", "left_anti").withColumn("ok", F.lit(True))
        both = pairs.join(checkpointed(ok), "p", "left")
        first = both.select(F.col("a").alias("src"), F.when(F.col("ok"), F.col("d")).otherwise(F.col("b")).alias("dst"), F.col("w1").alias("w"))
        second = both.where("c IS NOT NULL").select(F.col("c").alias("src"), F.when(F.col("ok"), F.col("b")).otherwise(F.col("d")).alias("dst"), F.col("w2").alias("w"))
        now = checkpointed(first.unionAll(second))
    return now


def control(name: str, edges: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    if name not in CONTROLS:
        raise ValueError(f"unknown control: {name}")
    made = {"biological": lambda: edges, "random_weights": lambda: random_weights(edges, seed), "target_shuffle": lambda: target_shuffle(edges, seed), "random_erdos": lambda: random_erdos(edges, nodes, seed), "random_degree_preserving": lambda: degree_preserving(edges, seed)}
    return made[name]()


def lineage(parent: str, name: str, seed: int, version: str = "2") -> dict:
    """Metadata of a control: only permuted weights keep anatomy."""
    return {"parent_graph_hash": parent, "control": name, "control_seed": seed, "science_version": version, "anatomical": name in ("biological", "random_weights")}


def cut(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those that touch a removed node."""
    off = removed.select("node").distinct()
    return edges.join(off, F.col("src") == F.col("node"), "left_anti").join(off, F.col("dst") == F.col("node"), "left_anti")


def how_many(n: int, fraction: float) -> int:
    return max(1, int(n * fraction)) if fraction > 0 else 0


def lesion_nodes(kind: str, edges: DataFrame, nodes: DataFrame, fraction: float = 0.0, region: str | None = None, seed: int = 0) -> DataFrame:
    """The nodes that a lesion removes."""
    if kind == "remove_region":
        return nodes.where(F.col("region") == region).select("node")
    k = how_many(nodes.count(), fraction)
    if kind == "remove_fraction":
        return nodes.select("node").orderBy(draw(seed, F.col("node")), "node").limit(k)
    sizes = nodes.select("node").join(degrees(edges).select("node", "degree"), "node", "left").fillna(0, ["degree"])
    if kind == "remove_high_degree":
        return sizes.orderBy(F.desc("degree"), F.desc("node")).limit(k).select("node")
    if kind == "remove_low_degree":
        return sizes.orderBy("degree", "node").limit(k).select("node")
    raise ValueError(f"unknown lesion: {kind}")


def randomise_region(edges: DataFrame, nodes: DataFrame, region: str, seed: int = 0) -> DataFrame:
    """Every source of a region keeps its number of edges and their weights, with other distinct targets, none itself.

    Targets of a source are consecutive places, after a start drawn from a hash of the source, in a drawn order of all
    nodes, so candidates are never enumerated.
    """
    from .reservoir import checkpointed

    named = checkpointed(numbered(nodes.select("node"), [draw(seed, F.col("node")), "node"], "i"))
    n = named.count()
    hit = edges.join(nodes.where(F.col("region") == region).select(F.col("node").alias("src")), "src", "left_semi")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    own = named.select(F.col("node").alias("src"), F.col("i").alias("own"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("src")), F.lit(n - 1))
    shift = F.pmod(start + F.col("k"), F.lit(n - 1)) + 1  # 1 .. n - 1 places after the source itself
    placed = hit.withColumn("k", rank).join(own, "src").select("src", "w", (F.pmod(F.col("own") - 1 + shift, F.lit(n)) + 1).alias("i"))
    moved = placed.join(named.select("i", F.col("node").alias("dst")), "i").select("src", "dst", "w")
    kept = edges.join(nodes.where(F.col("region") == region).select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "w")
    return kept.unionByName(moved)


def region_specs(nodes: DataFrame, least: int = 8) -> DataFrame:
    """Two lesions for every region of enough nodes: kind, region, label."""
    regions = nodes.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kinds = F.explode(F.array(F.lit("remove_region"), F.lit("randomize_region"))).alias("kind")
    return regions.select("region", "n", kinds).select("kind", "region", "n", label_of(F.col("kind"), F.lit(0.0), F.col("region")).alias("label"))


def label_of(kind, fraction, region):
    """A lesion's display name."""
    percent = F.format_string("%d%%", F.round(fraction * 100).cast("int"))
    return (
        F.when(kind == "remove_fraction", F.concat(F.lit("Remove "), percent, F.lit(" of neurons")))
        .when(kind == "remove_high_degree", F.concat(F.lit("Remove the most connected "), percent))
        .when(kind == "remove_low_degree", F.concat(F.lit("Remove the least connected "), percent))
        .when(kind == "randomize_weights", "Shuffle connection strengths")
        .when(kind == "remove_region", F.concat(F.lit("Disable "), F.replace(region, F.lit("_"), F.lit(" "))))
        .otherwise(F.concat(F.lit("Randomize "), F.replace(region, F.lit("_"), F.lit(" "))))
    )
