"""Fixed recurrent graphs: x <- (1 - leak) * x + leak * tanh(scale * A x + input), with activity flowing from src to dst.

Four physical forms give the same numbers. The relational one joins one state with edges and sums by destination. Many
examples at once run through the cone of their output nodes, where a few steps can feel only a part of the graph; else through a
broadcast compressed graph, below a checked size, or through the graph in blocks (``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import activation

#: Graphs above this size are never broadcast: 512 MB, at 12 bytes an edge and 24 a node.
BROADCAST_BYTES = 512 << 20
#: Numbers of a state in a task; products at once, which fit a cache; edges of a cone.
PIECE, PRODUCTS, CONE_EDGES = 1 << 20, 1 << 17, 1 << 21
#: Destinations of a strip of a broadcast graph.
STRIP = 1 << 15


def checkpoint_dir(spark: SparkSession) -> None:
    """Sets the checkpoint folder where none is set: spark.checkpoint.dir, or a folder of this machine if that is absent, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            import tempfile

            where = tempfile.mkdtemp(prefix="mossgraph-")
        spark.sparkContext.setCheckpointDir(where)


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage ends here, in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def incoming(state: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, z: sums of weight times activity over incoming edges; silent sources are skipped."""
    live = state.where("x <> 0").select(*keys, F.col("node").alias("src"), "x")
    return live.join(edges, "src").groupBy(*keys, F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("z"))


def step(state: DataFrame, edges: DataFrame, drive: DataFrame | None = None, leak: float = 0.3, scale: float = 1.0, keys: tuple[str, ...] = (), kind: str = "tanh", disabled: DataFrame | None = None) -> DataFrame:
    """One update. ``state``: keys, node, x of every node. ``drive``: keys, node, u."""
    on = [*keys, "node"]
    rows = state.join(incoming(state, edges, keys), on, "left")
    rows = rows.join(drive, on, "left") if drive is not None else rows.withColumn("u", F.lit(0.0))
    total = F.coalesce("z", F.lit(0.0)) * scale + F.coalesce("u", F.lit(0.0))
    rows = rows.select(*on, ((1 - leak) * F.col("x") + leak * activation(total, kind)).alias("x"))
    if disabled is not None:
        off = disabled.select("node", F.lit(True).alias("off")).distinct()
        rows = rows.join(off, "node", "left").select(*on, F.when(F.col("off"), 0.0).otherwise(F.col("x")).alias("x"))
    return rows


def run(state: DataFrame, edges: DataFrame, drive: DataFrame | None, steps: int, cut_every: int = 4, **options) -> DataFrame:
    """``steps`` updates; lineage is cut every few steps."""
    for t in range(1, steps + 1):
        state = step(state, edges, drive, **options)
        if t % cut_every == 0 and t < steps:
            state = checkpointed(state)
    return state


def trace(state: DataFrame, edges: DataFrame, drive: DataFrame | None, steps: int, **options) -> DataFrame:
    """The states of all steps, with column ``step``."""
    out = None
    for t in range(1, steps + 1):
        state = step(state, edges, drive, **options)
        now = state.withColumn("step", F.lit(t))
        out = now if out is None else out.unionByName(now)
    return out


def spectral_scale(edges: DataFrame, start: DataFrame, target: float = 0.9, steps: int = 40, cut_every: int = 8) -> DataFrame:
    """radius and factor = target / radius, by power iteration from ``start`` (node, x). An empty or vanishing graph keeps factor 1."""
    state = start
    for t in range(1, steps + 1):
        z = incoming(state, edges)
        size = z.agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("radius"))
        state = z.join(F.broadcast(size)).select("node", (F.col("z") / F.greatest("radius", F.lit(1e-300))).alias("x"), "radius")  # one row is broadcast
        if t % cut_every == 0 and t < steps:
            state = checkpointed(state)
        last, state = state, state.select("node", "x")
    radius = F.coalesce(F.max("radius"), F.lit(0.0))
    return last.agg(radius.alias("radius"), F.when(radius < 1e-12, 1.0).otherwise(target / radius).alias("factor"))


def spectral_radius(edges: DataFrame, nodes: DataFrame, steps: int = 40) -> float:
    """The radius as ``spectral_scale`` estimates it from ones at all nodes; by the broadcast form below its bound. 0 where activity vanishes."""
    made = compressed(edges, nodes)
    if made is None:
        return spectral_scale(edges, nodes.select("node", F.lit(1.0).alias("x")), 1.0, steps).first()["radius"]
    g, names = made
    x, radius = np.ones((len(names), 1)), 0.0
    for _ in range(steps):
        z = g.incoming(x)
        radius = float(np.sqrt((z * z).sum()))
        if radius < 1e-300:
            return 0.0
        x = z / radius
    return radius


def region_activity(state: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(state, "node", "left").groupBy("region").agg(F.avg(F.abs(F.coalesce("x", F.lit(0.0)))).alias("activity"))


def activity(state: DataFrame) -> DataFrame:
    return state.agg(F.avg(F.abs("x")).alias("mean_abs"), F.max(F.abs("x")).alias("max_abs"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def reachability(states: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """Nodes touched in any case of ``states`` (case, node, x)."""
    return states.groupBy("node").agg(F.bool_or(F.abs("x") > threshold).alias("touched"), F.max(F.abs("x")).alias("peak"))


class Compressed:
    """Edges by destination, for broadcasting: sums over incoming edges of many columns at once. They are kept in strips of destinations, with weights in the smallest type that has them exactly."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> None:
        order = np.lexsort((src, dst))
        rows, first = np.unique(dst[order], return_index=True)
        self.n, self.strips = n, [(rows, first, src[order].astype(np.int32), small(w[order]))] if len(rows) else []

    @classmethod
    def of(cls, strips: list[tuple], n: int) -> Compressed:
        """From strips: destinations, where their edges begin, sources and weights."""
        out = cls.__new__(cls)
        out.n, out.strips = n, strips
        return out

    def incoming(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        for rows, first, src, w in self.strips:
            out[rows] = summed(x, src, w[:, None], first)
        return out


def small(w: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that has all of them."""
    for kind in (np.uint8, np.float32):
        with np.errstate(invalid="ignore", over="ignore"):
            made = w.astype(kind)
        if (made.astype(float) == w).all():
            return made
    return w.astype(float)


def summed(x: np.ndarray, src: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x[src] * w over segments that begin at ``first``, ``PRODUCTS`` products at a time."""
    if x.ndim == 2 and x.shape[1] == 1:
        return summed(x[:, 0], src, w[:, 0], first)[:, None]
    most = max(1, PRODUCTS // (x.shape[1] if x.ndim == 2 else 1))
    if len(src) <= most:
        return np.add.reduceat(x[src] * w, first, axis=0)
    out = np.zeros((len(first), *x.shape[1:]))
    for a in range(0, len(src), most):
        b = min(a + most, len(src))
        r, end = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b)
        out[r:end] += np.add.reduceat(x[src[a:b]] * w[a:b], np.maximum(first[r:end], a) - a, axis=0)
    return out


class Cone:
    """What the picked nodes' states of ``steps`` steps from rest depend on. Step by step: rows that may be other than zero and that a later
    step reads, and the edges into them from rows that may be so before. Nodes are given by their place in the order of roles (the
    inputs come first), and numbered anew; the state holds those of the cone alone."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, inputs: int, picks: np.ndarray, steps: int) -> None:
        order = np.lexsort((src, dst))
        src, dst, w = src[order], dst[order], w[order]
        need = {steps: np.unique(picks)}
        for t in range(steps, 1, -1):
            hit = np.isin(dst, need[t])
            need[t - 1] = np.union1d(need[t], src[hit & (src < inputs)] if t == 2 else src[hit])
        rows = [need[1][need[1] < inputs]]
        ends = [np.zeros(0, np.int64)]
        for t in range(2, steps + 1):
            ends.append(np.flatnonzero(np.isin(dst, need[t]) & np.isin(src, rows[-1])))
            rows.append(np.intersect1d(need[t], np.union1d(rows[-1], dst[ends[-1]])))
        self.nodes = np.unique(np.concatenate([*rows, need[steps]]))
        self.inputs, self.edges = self.nodes[self.nodes < inputs], sum(map(len, ends))
        place = lambda x: np.searchsorted(self.nodes, x)
        self.picks, self.plan = place(picks), []
        for r, e in zip(rows, ends, strict=True):
            to, first = np.unique(dst[e], return_index=True)
            self.plan.append((place(r), np.searchsorted(r, to), first, place(src[e]).astype(np.int32), w[e][:, None]))

    def weights(self, inputs: int, dim: int, scale: float, seed: int, chunk: int = 1 << 14) -> np.ndarray:
        """The rows of ``input_weights`` of the cone's inputs."""
        rng, out = np.random.default_rng(seed), [np.zeros((0, dim))]
        for a in range(0, inputs, chunk):
            rows = rng.uniform(-1, 1, (min(chunk, inputs - a), dim))
            rows = rows[self.inputs[(self.inputs >= a) & (self.inputs < a + chunk)] - a]
            out.append(rows * scale / np.linalg.norm(rows, axis=1, keepdims=True))
        return np.concatenate(out)

    def run(self, z: list[np.ndarray], leak: float, scale: float) -> np.ndarray:
        """steps by picked nodes by examples; ``z``: for every step the inputs' drive (inputs by examples)."""
        x, seen = np.zeros((len(self.nodes), z[0].shape[1])), []
        for (rows, to, first, src, w), now in zip(self.plan, z, strict=True):
            total = np.zeros((len(rows), x.shape[1]))
            if len(src):
                total[to] = scale * summed(x, src, w, first)
            ins = np.searchsorted(rows, len(self.inputs))  # the inputs are the first places
            total[:ins] += now[rows[:ins]]
            x[rows] = (1 - leak) * x[rows] + leak * np.tanh(total)
            seen.append(x[self.picks])
        return np.array(seen)


def coned(edges: DataFrame, nodes: DataFrame, inputs: int, outputs: int, dim: int, input_scale: float, steps: int, seed: int = 42) -> tuple[Cone, np.ndarray, np.ndarray, int] | None:
    """The cone of the output nodes, its inputs' weights and strengths (sums of their incoming edges' magnitudes) and the number of nodes; None where it has more than ``CONE_EDGES`` edges or is beyond ``BROADCAST_BYTES``.

    It is found backwards by joins with the nodes that a step reads, so only its own edges reach the driver.
    """
    from . import blocks

    names, edges = blocks.ordered(nodes, seed), edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    spark, n = edges.sparkSession, names.count()
    first, rest = min(inputs, n), n - inputs
    picks = np.array([inputs + p % rest if rest > 0 else p % n for p in range(outputs)] if n else [], np.int64)
    if not n or not outputs or min(CONE_EDGES * 12, BROADCAST_BYTES) == 0:
        return None
    numbered_ = lambda ids: names.join(F.broadcast(spark.createDataFrame(pa.table({"node": ids}))), "node", "left_semi").toArrow()
    into = lambda ids: edges.join(F.broadcast(spark.createDataFrame(pa.table({"dst": ids}))), "dst", "left_semi").select("src", "dst", "w")
    chosen = names.where(F.col("idx").isin(np.unique(picks).tolist())).toArrow()  # the outputs
    ids = chosen.column("node").combine_chunks()
    if edges.limit(CONE_EDGES // 4 + 1).count() <= CONE_EDGES // 4:
        got = edges.toArrow()
    else:
        got = None
        for t in range(steps, 1, -1):
            part = into(ids) if t > 2 else into(ids).join(names.where(F.col("idx") < first).select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst", "w")
            part = part.limit(CONE_EDGES + 1).toArrow()
            if part.num_rows > CONE_EDGES:
                return None
            if t > 2:
                got = part  # holds those of later steps
                ids = pa.concat_arrays([ids, part.column("src").combine_chunks()]).unique()
            elif got is None:
                got = part
            else:
                known = pc.is_in(part.column("dst"), got.column("dst").combine_chunks())  # of these all edges are there
                got = pa.concat_tables([got, part.filter(pc.invert(known))])
    if got.num_rows * 12 > BROADCAST_BYTES:
        return None
    ends = pa.concat_arrays([got.column(c).combine_chunks() for c in ("src", "dst")]).unique()
    places = pa.concat_tables([numbered_(ends), chosen]).group_by("node").aggregate([("idx", "min")])
    at = [pc.index_in(got.column(c), places.column("node").combine_chunks()) for c in ("src", "dst")]
    inside = pc.and_(*(pc.is_valid(x) for x in at)).to_numpy(zero_copy_only=False)
    idx = places.column("idx_min").to_numpy()
    src, dst = (idx[x.fill_null(0).to_numpy().astype(np.int64)][inside] for x in at)
    cone = Cone(src, dst, got.column("w").to_numpy()[inside], first, picks, steps)
    if cone.edges > 2 * CONE_EDGES:
        return None
    mine = names.join(F.broadcast(spark.createDataFrame(pa.table({"idx": pa.array(cone.inputs, pa.int64())}))), "idx", "left_semi")
    strong = dict(map(tuple, edges.join(F.broadcast(mine.withColumnRenamed("node", "dst")), "dst").groupBy("idx").agg(F.sum(F.abs("w"))).collect()))  # the cone's inputs
    return cone, cone.weights(first, dim, input_scale, seed), np.array([strong.get(int(i), 0.0) for i in cone.inputs]), n


def cone_states(examples: DataFrame, made: tuple[Cone, np.ndarray, np.ndarray, int], steps: int, leak: float, scale: float, washout: int = 0, key: str = "id") -> DataFrame:
    """key, least, mean, last: as ``batch_states``, by a cone. ``least``: what the energy is at least, since the inputs that are driven harder than all their
    incoming edges could drive them keep the sign of their drive."""
    shared = examples.sparkSession.sparkContext.broadcast(made)
    kind = examples.schema[key].dataType.simpleString()
    bounds = [1 - (1 - leak) ** t for t in range(steps)]  # of a state after t steps

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cone, win, strengths, n = shared.value
        most = max(1, PIECE // max(1, len(cone.nodes)))
        for rows in batches:
            for at in range(0, rows.num_rows, most):
                part = rows.slice(at, most)
                u = np.array(part.column("u").to_pylist(), float)
                z = [win @ u.T] * steps if u.ndim == 2 else [win @ u[:, t].T for t in range(steps)]
                seen = cone.run(z, leak, scale)
                sign = np.sign(z[0])
                firm = [np.where(np.sign(z[t]) == sign, np.abs(z[t]) - abs(scale) * bounds[t] * strengths[:, None], 0.0) for t in range(steps)]
                least = sum(leak * (1 - leak) ** (steps - 1 - t) * np.tanh(np.maximum(f, 0.0)) for t, f in enumerate(firm))
                least = np.where(np.min(firm, axis=0) > 0, least, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.sqrt((least * least).sum(0) / n)), *(pa.array(list(np.ascontiguousarray(x.T)), pa.list_(pa.float64())) for x in (seen[washout:].mean(0), seen[-1]))], [key, "least", "mean", "last"])

    spark = examples.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return examples.select(key, "u").repartition(tasks).mapInArrow(work, f"{key} {kind}, least double, mean array<double>, last array<double>")


def compressed(edges: DataFrame, nodes: DataFrame) -> tuple[Compressed, list] | None:
    """The graph for broadcasting and its nodes in order; None if it has more than ``BROADCAST_BYTES``. Tasks number and sort the edges; the driver gets packed strips."""
    if edges.count() * 12 + nodes.count() * 24 > BROADCAST_BYTES:
        return None
    from .controls import numbered
    from .graph import renumbered

    named = checkpointed(numbered(nodes.select("node").distinct(), ["node"], "i").select("node", (F.col("i") - 1).alias("idx")))
    names = named.orderBy("idx").select("node").toArrow().column("node").to_numpy(zero_copy_only=False)

    def pack(table: pa.Table) -> pa.Table:
        src, dst, w = (table.column(c).to_numpy() for c in ("src_idx", "dst_idx", "w"))
        order = np.lexsort((src, dst))
        rows, first = np.unique(dst[order], return_index=True)
        w = small(w[order])
        parts = [x.tobytes() for x in (rows.astype(np.int32), first.astype(np.int32), src[order].astype(np.int32), w)]
        return pa.table({"kind": [w.dtype.str], **{k: pa.array([x], pa.binary()) for k, x in zip("abcd", parts, strict=True)}})

    ends = renumbered(edges, named).withColumn("w", F.col("w").cast("double"))
    strips = ends.groupBy(F.floor(F.col("dst_idx") / STRIP).alias("strip")).applyInArrow(pack, "kind string, a binary, b binary, c binary, d binary").toArrow()
    kinds, held = strips.column("kind").to_pylist(), [strips.column(c) for c in "abcd"]
    made = [tuple(np.frombuffer(held[k][i].as_buffer(), t) for k, t in enumerate((np.int32, np.int32, np.int32, kind))) for i, kind in enumerate(kinds)]
    return Compressed.of(made, len(names)), names.tolist()


def states(examples: DataFrame, edges: DataFrame, nodes: DataFrame, inputs: int, outputs: int, dim: int, input_scale: float, steps: int, leak: float, scale: float, key: str, seed: int = 42, least: float | None = None) -> DataFrame:
    """key, energy, last: for every example (key, u) the states of the output nodes after ``steps``. Roles are drawn from the seed.

    A graph of a checked size goes to every task; a larger one is run in blocks, to the same numbers. With ``least`` the energy is needed only as
    far as it is less: ``last`` comes from the outputs' cone, with a bound below the energy, and only examples whose bound is under ``least`` have whole states made.
    """
    if least is not None and (cone := coned(edges, nodes, inputs, outputs, dim, input_scale, steps, seed)) is not None:
        got = checkpointed(cone_states(examples, cone, steps, leak, scale, key=key).select(key, F.col("least").alias("energy"), "last"))
        low = got.where(F.col("energy") < least)
        if low.isEmpty():
            return got
        whole = states(examples.join(low.select(key), key, "left_semi"), edges, nodes, inputs, outputs, dim, input_scale, steps, leak, scale, key, seed)
        return checkpointed(got.where(F.col("energy") >= least).unionByName(whole))
    made = compressed(edges, nodes)
    if made is not None:
        g, names = made
        ins, outs = picked_roles(names, seed, inputs, outputs)
        return batch_states(examples, g, sparse_weights(ins, dim, input_scale, seed), steps, leak, scale, outs, key=key).select(key, "energy", "last")
    from . import blocks

    net = blocks.built(edges, nodes, inputs, outputs, dim, input_scale, seed)
    return blocks.batch_states(examples, net, steps, leak, scale, key=key).select(key, "energy", "last")


def batch_states(examples: DataFrame, graph: Compressed, win: np.ndarray, steps: int, leak: float, scale: float, picks: np.ndarray, washout: int = 0, key: str = "id", batch: int = 128) -> DataFrame:
    """key, energy, mean, last: for every example (key, u: its drive vector, or one for each step) the states of nodes ``picks``, the mean over steps after the washout and the last. ``win``: node by drive dimension."""
    shared = examples.sparkSession.sparkContext.broadcast((graph, sparse(win)))
    kind = examples.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, w = shared.value
        most = max(1, min(batch, 4 * PIECE // max(1, g.n)))
        for rows in batches:
            for at in range(0, rows.num_rows, most):
                part = rows.slice(at, most)
                u = np.array(part.column("u").to_pylist(), float)
                x = np.zeros((g.n, len(u)))
                mean = np.zeros((len(picks), len(u)))
                for t in range(steps):
                    x = stepped(g, x, w, u if u.ndim == 2 else u[:, t], leak, scale)
                    if t >= washout:
                        mean += x[picks]
                energy = np.sqrt((x * x).mean(0))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(energy), pa.array((mean / (steps - washout)).T.tolist()), pa.array(x[picks].T.tolist())], [key, "energy", "mean", "last"])

    spark = examples.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a few rows are much work here, and small inputs arrive in few partitions
    return examples.select(key, "u").repartition(tasks).mapInArrow(work, f"{key} {kind}, energy double, mean array<double>, last array<double>")


def sparse(win: np.ndarray | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Input weights (node by dimension) as the nodes that have any, and theirs."""
    if isinstance(win, tuple):
        return win
    ins = np.flatnonzero(win.any(1))
    return ins, win[ins]


def stepped(g: Compressed, x: np.ndarray, win: tuple[np.ndarray, np.ndarray], u: np.ndarray, leak: float, scale: float, noise: np.ndarray | None = None) -> np.ndarray:
    """The next states (node by example) under drives ``u`` (example by dimension)."""
    z = g.incoming(x)
    z *= scale
    z[win[0]] += win[1] @ u.T
    if noise is not None:
        z += noise[:, None]
    np.tanh(z, out=z)
    z *= leak
    z += (1 - leak) * x
    return z


def sparse_weights(inputs: np.ndarray, dim: int, scale: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """``input_weights`` as the input nodes and their rows."""
    rows = np.random.default_rng(seed).uniform(-1, 1, (len(inputs), dim))
    return inputs, rows * scale / np.linalg.norm(rows, axis=1, keepdims=True)


def input_weights(nodes: int, inputs: np.ndarray, dim: int, scale: float, seed: int = 42) -> np.ndarray:
    """Random rows of length ``scale`` at the input nodes, zero elsewhere."""
    out = np.zeros((nodes, dim))
    rows = np.random.default_rng(seed).uniform(-1, 1, (len(inputs), dim))
    out[inputs] = rows * scale / np.linalg.norm(rows, axis=1, keepdims=True)
    return out


def picked_roles(names: list, seed: int, inputs: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of input nodes and of output nodes, disjoint, in an order drawn from the seed."""
    import hashlib

    raw = bytearray()
    for name in names:
        raw += hashlib.md5(f"{seed}:{name}".encode()).digest()
    high, low = np.frombuffer(bytes(raw), ">u8").reshape(-1, 2).T
    order = np.lexsort((low, high))
    rest = order[inputs:] if len(order) > inputs else order
    return order[:inputs].astype(np.int64), rest[np.arange(outputs if len(rest) else 0) % max(1, len(rest))].astype(np.int64)


def weighted_sample(edges: DataFrame, k: int, uniform: Column) -> DataFrame:
    """k edges without replacement, with probability in proportion to weight: least -ln(u) / w."""
    return edges.where("w > 0").withColumn("rank_key", -F.log(F.greatest(uniform, F.lit(1e-300))) / F.col("w")).orderBy("rank_key", "src", "dst").limit(k)
