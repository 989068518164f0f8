"""Graph queries over the part-succession graph of lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import draw, uniform
from ..operators import blocks, controls, graph, reservoir
from ..registry import ORACLES, query, table

EDGES = """e AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)"""
NODES = "n AS (SELECT p_partkey AS node, p_brand AS region FROM part)"
WITH = f"WITH {EDGES}, {NODES}"
DEGREES = "d AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o + i)::BIGINT AS degree, sum(w) AS strength FROM (SELECT src AS node, 1 AS o, 0 AS i, w FROM e UNION ALL SELECT dst, 0, 1, w FROM e) GROUP BY node)"


def edges(spark, sf_dir):
    return graph.succession(table(spark, sf_dir, "lineitem"))


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("region"))


@query(f"{WITH} SELECT * FROM e")
def edge_build(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"{WITH} SELECT src, dst, w FROM e WHERE w >= 2 AND src IN (SELECT node FROM n WHERE region <> 'Brand#11') AND dst IN (SELECT node FROM n WHERE region <> 'Brand#11')")
def edge_filter(spark, sf_dir):
    return graph.kept_edges(edges(spark, sf_dir), nodes(spark, sf_dir).where("region <> 'Brand#11'"))


@query(f"{WITH}, k AS (SELECT w, w >= 2 AND src IN (SELECT node FROM n WHERE region <> 'Brand#11') AND dst IN (SELECT node FROM n WHERE region <> 'Brand#11') AS keep FROM e) SELECT count(*) FILTER (keep) AS retained, count(*) FILTER (NOT keep) AS excluded, coalesce(sum(w) FILTER (keep), 0)::DOUBLE AS contacts FROM k")
def edge_rejects(spark, sf_dir):
    return graph.accounting(edges(spark, sf_dir), nodes(spark, sf_dir).where("region <> 'Brand#11'"))


@query(f"{WITH}, {DEGREES} SELECT node, out_degree, in_degree, degree FROM d")
def node_degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir)).drop("strength")


@query(f"{WITH}, {DEGREES} SELECT node, strength FROM d")
def node_strength(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir)).select("node", "strength")


@query(f"{WITH}, {DEGREES}, t AS (SELECT node FROM d ORDER BY strength DESC, node LIMIT 512) SELECT src, dst, w FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)")
def top_degree_subgraph(spark, sf_dir):
    e = reservoir.checkpointed(edges(spark, sf_dir))
    return graph.induced(e, graph.top_nodes(e, 512), loops=True)


@query(f"{WITH}, i AS (SELECT node, (row_number() OVER (ORDER BY node) - 1) AS idx FROM n) SELECT a.idx AS src_idx, b.idx AS dst_idx, w FROM e JOIN i a ON src = a.node JOIN i b ON dst = b.node")
def edge_renumber(spark, sf_dir):
    return graph.renumbered(edges(spark, sf_dir), controls.numbered(nodes(spark, sf_dir), ["node"], "i").select("node", (F.col("i") - 1).alias("idx")))


@query(f"{WITH}, o AS (SELECT node, coalesce(k, 0) AS out_degree FROM n LEFT JOIN (SELECT src, count(*) AS k FROM e GROUP BY src) ON src = node) SELECT node, out_degree, (sum(out_degree) OVER (ORDER BY node) - out_degree)::BIGINT AS row_start, (sum(out_degree) OVER (ORDER BY node))::BIGINT AS row_stop FROM o")
def csr_offsets(spark, sf_dir):
    return graph.csr_offsets(edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"{WITH}, s AS (SELECT node FROM n ORDER BY md5('94:' || node), node LIMIT 360) SELECT src, dst, w FROM e WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s) AND src <> dst")
def induced_subgraph(spark, sf_dir):
    return graph.induced(edges(spark, sf_dir), nodes(spark, sf_dir).orderBy(draw(94, F.col("node")), "node").limit(360))


@query(f"{WITH} SELECT src, dst, w FROM e WHERE src % 5 = 0 AND dst % 5 = 0 ORDER BY src, dst LIMIT 900")
def display_edges(spark, sf_dir):
    return graph.display(edges(spark, sf_dir), nodes(spark, sf_dir).withColumn("idx", F.col("node")), 5, 900)


_MASK = "(CASE WHEN contains(p_type, 'BRASS') OR contains(p_name, 'sensory') THEN 1 ELSE 0 END + CASE WHEN p_brand IN ('motor', 'descending') THEN 2 ELSE 0 END + CASE WHEN p_size > 25 THEN 4 ELSE 0 END + CASE WHEN p_retailprice > 1200 THEN 8 ELSE 0 END)"


@query(f"SELECT p_partkey AS node, {_MASK}::INTEGER AS flags, list_filter([CASE WHEN {_MASK} & 1 > 0 THEN 'input' END, CASE WHEN {_MASK} & 2 > 0 THEN 'output' END, CASE WHEN {_MASK} & 4 > 0 THEN 'vnc' END], lambda x: x IS NOT NULL) AS roles FROM part")
def role_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    superclass = F.when(F.col("p_type").contains("BRASS"), "sensory_part").otherwise(F.col("p_brand"))
    mask = graph.role_mask(superclass, F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_size")), F.col("p_retailprice") > 1200)
    return p.select(F.col("p_partkey").alias("node"), mask.alias("flags"), graph.roles(mask).alias("roles"))


_CASES = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{r}'" for r, p in graph.REGIONS)


@query(f"SELECT p_partkey AS node, CASE {_CASES} ELSE '{graph.OTHER_REGION}' END AS region FROM (SELECT p_partkey, upper(coalesce(nullif(p_name, ''), 'unknown')) AS t FROM part)")
def region_classify(spark, sf_dir):
    """Regions by whole part names."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), graph.region_of(F.col("p_name")).alias("region"))


_KINDS = ("KCab", "mbon3", "APL", "epg", "Delta7", "ELLx", "T4a", "LPi", "xOLy", "orn", "ALp", "DNs1", "MN", "SMP", "")


@query(f"""SELECT label, count(*) AS n, list_sort(list(DISTINCT CASE {_CASES} ELSE '{graph.OTHER_REGION}' END)) AS regions
FROM (SELECT label, upper(coalesce(nullif(label || coalesce(p_name, ''), ''), 'unknown')) AS t FROM (SELECT ({list(_KINDS)})[p_partkey % {len(_KINDS)} + 1] AS label, p_name FROM part)) GROUP BY label""")
def region_rules(spark, sf_dir):
    """Every rule of the classifier: parts as cell types, whose names begin with one of the kinds that the rules tell apart."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS)).cast("int") + 1)
    types = table(spark, sf_dir, "part").select(kind.alias("label"), F.concat(kind, F.coalesce("p_name", F.lit(""))).alias("type"))
    return types.groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(graph.region_of(F.col("type")))).alias("regions"))


@query(f"{WITH} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(DISTINCT region) FROM n) AS n_regions, count(*) AS n_edges, sum(w) AS total_weight FROM e")
def graph_summary(spark, sf_dir):
    return graph.summary(edges(spark, sf_dir), nodes(spark, sf_dir))


_ROW = "md5(src || ':' || dst || ':' || printf('%.6f', w))"


@query(f"{WITH} SELECT count(*) AS n_edges, sha256(count(*) || ':' || {" || ':' || ".join(f"sum(('0x' || substr({_ROW}, {8 * k + 1}, 8))::BIGINT)" for k in range(4))}) AS digest FROM e")
def table_fingerprint(spark, sf_dir):
    return graph.fingerprint(edges(spark, sf_dir))


@query("SELECT min(p_size) AS min_x, max(p_size) AS max_x, min(p_retailprice) AS min_y, max(p_retailprice) AS max_y FROM part WHERE p_size > 10")
def coordinate_bounds(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 10").agg(F.min("p_size").alias("min_x"), F.max("p_size").alias("max_x"), F.min("p_retailprice").alias("min_y"), F.max("p_retailprice").alias("max_y"))


# --- recurrence ---
SCALE, LEAK = 0.01, 0.28
_DRIVE = "u AS (SELECT node, CASE WHEN node % 7 = 0 THEN 0.5 + (node % 10) / 20.0 ELSE 0 END::DOUBLE AS u FROM n)"


def _steps(k: int) -> str:
    out = ["x0 AS (SELECT node, 0.0::DOUBLE AS x FROM n)"]
    for t in range(1, k + 1):
        out.append(f"z{t} AS (SELECT dst AS node, sum(w * x) AS z FROM e JOIN x{t - 1} ON src = node WHERE x <> 0 GROUP BY dst)")
        out.append(f"x{t} AS (SELECT node, (1 - {LEAK}::DOUBLE) * x + {LEAK}::DOUBLE * tanh(coalesce(z, 0) * {SCALE}::DOUBLE + u) AS x FROM x{t - 1} LEFT JOIN z{t} USING (node) JOIN u USING (node))")
    return ", ".join(out)


def _setup(spark, sf_dir):
    n = nodes(spark, sf_dir)
    drive = n.select("node", F.when(F.col("node") % 7 == 0, 0.5 + (F.col("node") % 10) / 20.0).otherwise(0.0).alias("u"))
    return n, reservoir.checkpointed(edges(spark, sf_dir)), drive, n.select("node", F.lit(0.0).alias("x"))


def _after(spark, sf_dir, k):
    n, e, drive, start = _setup(spark, sf_dir)
    return n, reservoir.run(start, e, drive, k, leak=LEAK, scale=SCALE)


@query(f"{WITH}, {_DRIVE}, {_steps(2)} SELECT node, round(x, 6) AS x FROM x2")
def spmv_step(spark, sf_dir):
    return _after(spark, sf_dir, 2)[1].select("node", F.round("x", 6).alias("x"))


@query(f"{WITH}, {_DRIVE}, {_steps(4)} SELECT node, round(x, 6) AS x FROM x4")
def reservoir_4step(spark, sf_dir):
    return _after(spark, sf_dir, 4)[1].select("node", F.round("x", 6).alias("x"))


@query(f"{WITH}, {_DRIVE}, {_steps(4)} SELECT region, round(avg(abs(x)), 6) AS activity FROM n JOIN x4 USING (node) GROUP BY region")
def region_activity(spark, sf_dir):
    n, x = _after(spark, sf_dir, 4)
    return reservoir.region_activity(x, n).select("region", F.round("activity", 6).alias("activity"))


@query(f"{WITH}, {_DRIVE}, {_steps(4)} SELECT round(avg(abs(x)), 6) AS mean_abs, round(max(abs(x)), 6) AS max_abs, round(sqrt(avg(x * x)), 6) AS rms FROM x4")
def activity_rms(spark, sf_dir):
    return reservoir.activity(_after(spark, sf_dir, 4)[1]).select(*[F.round(c, 6).alias(c) for c in ("mean_abs", "max_abs", "rms")])


@query(f"{WITH}, {_DRIVE}, {_steps(4)} SELECT round(sqrt(avg((b.x - a.x) * (b.x - a.x))), 6) AS delta FROM x3 a JOIN x4 b USING (node)")
def step_delta(spark, sf_dir):
    n, e, drive, start = _setup(spark, sf_dir)
    x3 = reservoir.run(start, e, drive, 3, leak=LEAK, scale=SCALE)
    x4 = reservoir.step(x3, e, drive, LEAK, SCALE)
    both = x3.withColumnRenamed("x", "a").join(x4, "node")
    return both.agg(F.round(F.sqrt(F.avg((F.col("x") - F.col("a")) * (F.col("x") - F.col("a")))), 6).alias("delta"))


@query(f"{WITH}, {_DRIVE}, {_steps(4)} SELECT node, round(x, 6) AS x FROM x4 WHERE abs(x) > 1e-7 ORDER BY abs(x) DESC, node LIMIT 420")
def top_active(spark, sf_dir):
    return _after(spark, sf_dir, 4)[1].where("abs(x) > 1e-7").orderBy(F.desc(F.abs("x")), "node").limit(420).select("node", F.round("x", 6).alias("x"))


@query(f"{WITH}, {_DRIVE}, {_steps(4)}, a AS (SELECT 1 AS step, * FROM x1 UNION ALL SELECT 2, * FROM x2 UNION ALL SELECT 3, * FROM x3 UNION ALL SELECT 4, * FROM x4) SELECT step, node, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY abs(x) DESC, node) AS r FROM a WHERE abs(x) > 1e-7) WHERE r <= 50")
def step_frames(spark, sf_dir):
    """A frame of the 50 most active nodes for every step."""
    from pyspark.sql import Window

    n, e, drive, start = _setup(spark, sf_dir)
    rows = reservoir.trace(start, e, drive, 4, leak=LEAK, scale=SCALE).where("abs(x) > 1e-7")
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.desc(F.abs("x")), "node"))
    return rows.withColumn("r", rank).where("r <= 50").select("step", "node", F.round("x", 6).alias("x"))


@query(f"{WITH}, {_DRIVE}, {_steps(2)} SELECT count(*) AS nodes, count(*) FILTER (abs(x) > 1e-6) AS touched, round(max(abs(x)), 6) AS peak FROM x2")
def reachability(spark, sf_dir):
    x = _after(spark, sf_dir, 2)[1]
    r = reservoir.reachability(x.withColumn("case", F.lit(1)))
    return r.agg(F.count("*").alias("nodes"), F.count_if("touched").alias("touched"), F.round(F.max("peak"), 6).alias("peak"))


def _power(k: int) -> str:
    out = ["x0 AS (SELECT node, 1.0::DOUBLE AS x FROM n)"]
    for t in range(1, k + 1):
        out.append(f"z{t} AS (SELECT dst AS node, sum(w * x) AS z FROM e JOIN x{t - 1} ON src = node GROUP BY dst)")
        out.append(f"x{t} AS (SELECT node, z / (SELECT sqrt(sum(z * z)) FROM z{t}) AS x FROM z{t})")
    return ", ".join(out)


@query(f"{WITH}, {_power(6)} SELECT round(sqrt(sum(z * z)), 4) AS radius, round(0.9::DOUBLE / sqrt(sum(z * z)), 8) AS factor FROM z6")
def power_iteration(spark, sf_dir):
    n, e, _, _ = _setup(spark, sf_dir)
    return reservoir.spectral_scale(e, n.select("node", F.lit(1.0).alias("x")), 0.9, 6).select(F.round("radius", 4).alias("radius"), F.round("factor", 8).alias("factor"))


@query(ORACLES["reservoir_4step"])
def reservoir_vectorised(spark, sf_dir):
    """The 4-step states by the broadcast form, of two drives side by side."""
    import numpy as np
    import pyarrow as pa

    n, e, drive, start = _setup(spark, sf_dir)
    made = reservoir.compressed(e, n)
    if made is None:
        return reservoir.run(start, e, drive, 4, leak=LEAK, scale=SCALE).select("node", F.round("x", 6).alias("x"))
    g, names = made
    node = np.array(names, np.int64)
    win = np.where(node % 7 == 0, 0.5 + node % 10 / 20.0, 0.0)[:, None]
    rows = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id long, u array<double>")
    got = reservoir.batch_states(rows, g, win, 4, LEAK, SCALE, np.arange(len(names)))
    places = spark.createDataFrame(pa.table({"pos": pa.array(np.arange(len(node)), pa.int32()), "node": node}))
    return got.where("id = 1").select(F.posexplode("last").alias("pos", "x")).join(places, "pos").select("node", F.round("x", 6).alias("x"))


@query(ORACLES["reservoir_4step"])
def reservoir_blocks(spark, sf_dir):
    """The 4-step states by the graph in blocks, each of 512 nodes."""
    n, e, drive, _ = _setup(spark, sf_dir)
    net = blocks.built(e, n, 0, 0, 1, 1.0, weights=drive.where("u <> 0").select("node", F.array("u").alias("weights")), size=512)
    dyn, numbers, groups = blocks.started(net, spark.createDataFrame([(1, [1.0])], "id long, u array<double>"), "id")
    dyn, _ = blocks.run(net, dyn, groups, 4, LEAK, SCALE)
    return blocks.states_of(net, dyn, numbers, "id").select("node", F.round("x", 6).alias("x"))


# --- controls and lesions ---
_PERMUTE = "a AS (SELECT *, row_number() OVER (ORDER BY src, dst) AS rn FROM e), b AS (SELECT w AS w2, dst AS dst2, row_number() OVER (ORDER BY md5('{0}:' || src || ':' || dst), src, dst) AS rn FROM e)"


@query(f"{WITH}, {_PERMUTE.format(7)} SELECT src, dst, w2 AS w FROM a JOIN b USING (rn)")
def control_weight_permute(spark, sf_dir):
    return controls.random_weights(reservoir.checkpointed(edges(spark, sf_dir)), 7)


@query(f"{WITH}, {_PERMUTE.format(8)} SELECT src, dst2 AS dst, w FROM a JOIN b USING (rn)")
def control_target_shuffle(spark, sf_dir):
    return controls.target_shuffle(reservoir.checkpointed(edges(spark, sf_dir)), 8)


@query(f"{WITH} SELECT count(*) AS n_edges, 0 AS loops, count(*) AS pairs, sum(w) AS total_weight, (SELECT count(*) FROM n) AS n_nodes FROM e")
def control_erdos(spark, sf_dir):
    """What a drawn graph must keep: edges, no loops, no repeats, the weights' sum."""
    made = reservoir.checkpointed(controls.random_erdos(reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir), 3))
    return made.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).cast("int").alias("loops"), F.count_distinct("src", "dst").alias("pairs"), F.sum("w").alias("total_weight"), F.lit(table(spark, sf_dir, "part").count()).cast("long").alias("n_nodes"))


@query(f"{WITH}, {DEGREES} SELECT node, out_degree, in_degree FROM d")
def control_degree_preserving(spark, sf_dir):
    """Both degrees of every node after the swaps: they must be those before."""
    made = controls.degree_preserving(reservoir.checkpointed(edges(spark, sf_dir)), 5, rounds=3)
    return graph.degrees(made).select("node", "out_degree", "in_degree")


_LESION = "SELECT src, dst, w FROM e WHERE src NOT IN (SELECT node FROM k) AND dst NOT IN (SELECT node FROM k)"
_ALL_DEGREES = "f AS (SELECT n.node, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (node))"


def _lesion(spark, sf_dir, kind, **options):
    e, n = reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir)
    return controls.cut(e, controls.lesion_nodes(kind, e, n, **options))


@query(f"{WITH}, k AS (SELECT node FROM n ORDER BY md5('11:' || node), node LIMIT (SELECT greatest(1, count(*) // 20) FROM n)) {_LESION}")
def lesion_fraction(spark, sf_dir):
    return _lesion(spark, sf_dir, "remove_fraction", fraction=0.05, seed=11)


@query(f"{WITH}, {DEGREES}, {_ALL_DEGREES}, k AS (SELECT node FROM f ORDER BY degree DESC, node DESC LIMIT (SELECT greatest(1, count(*) // 20) FROM n)) {_LESION}")
def lesion_high_degree(spark, sf_dir):
    return _lesion(spark, sf_dir, "remove_high_degree", fraction=0.05)


@query(f"{WITH}, {DEGREES}, {_ALL_DEGREES}, k AS (SELECT node FROM f ORDER BY degree, node LIMIT (SELECT greatest(1, count(*) // 20) FROM n)) {_LESION}")
def lesion_low_degree(spark, sf_dir):
    return _lesion(spark, sf_dir, "remove_low_degree", fraction=0.05)


@query(f"{WITH}, k AS (SELECT node FROM n WHERE region = 'Brand#22') {_LESION}")
def lesion_region(spark, sf_dir):
    return _lesion(spark, sf_dir, "remove_region", region="Brand#22")


@query(f"{WITH} SELECT src, count(*) AS out_degree, count(*) AS targets, 0 AS loops, sum(w) AS weight FROM e WHERE src IN (SELECT node FROM n WHERE region = 'Brand#22') GROUP BY src")
def lesion_randomise_region(spark, sf_dir):
    """What the affected sources keep: number of edges, all different and none to itself, and weight."""
    made = controls.randomise_region(reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir), "Brand#22", 4)
    hit = made.join(nodes(spark, sf_dir).where("region = 'Brand#22'").select(F.col("node").alias("src")), "src", "left_semi")
    return hit.groupBy("src").agg(F.count("*").alias("out_degree"), F.count_distinct("dst").alias("targets"), F.count_if(F.col("src") == F.col("dst")).cast("int").alias("loops"), F.sum("w").alias("weight"))


@query(f"{WITH} SELECT unnest(['remove_region', 'randomize_region']) AS kind, region, count(*) AS n, unnest(['Disable ' || region, 'Randomize ' || region]) AS label FROM n GROUP BY region HAVING count(*) >= 8")
def region_spec_candidates(spark, sf_dir):
    return controls.region_specs(nodes(spark, sf_dir))


@query(f"{WITH} SELECT src, dst, w FROM (SELECT *, -ln(greatest(('0x' || substr(md5('5:' || src || ':' || dst), 1, 13))::BIGINT::DOUBLE / {16**13}, 1e-300)) / w AS k FROM e) ORDER BY k, src, dst LIMIT 1600")
def weighted_sample(spark, sf_dir):
    return reservoir.weighted_sample(edges(spark, sf_dir), 1600, uniform(5, F.col("src"), F.col("dst"))).drop("rank_key")


@query(f"{WITH} SELECT node FROM n ORDER BY md5('360:' || node), node LIMIT 360")
def node_sample(spark, sf_dir):
    return nodes(spark, sf_dir).orderBy(draw(360, F.col("node")), "node").limit(360).select("node")
