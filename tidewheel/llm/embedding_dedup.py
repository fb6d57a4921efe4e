"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length one, so a cosine bound is a distance bound epsilon.  They are
sorted by label and by the grid cells (side epsilon) of their leading principal
coordinates; the sorted sequence is cut into blocks, each with its bounding box in those
coordinates.  Pairs of blocks come from an equi-join on shared or neighbouring cells of
as many coordinates as blocks are narrow in, and those whose boxes lie farther apart than epsilon are skipped.
What is left is dealt to tasks by host block and a bounded group of its guests, and joined recursively: the longer interval is halved, halves too distant are
skipped, and small intervals are compared by one matrix product in double precision.

Identical vectors of a label collapse to one class first, so a group of copies is one row
whatever its size.  A pair of blocks yields link counts per vector and a spanning forest
of its links, never the links themselves.

Defined cases: vectors that are null, zero or hold null or non-finite components, and
vectors without a label, link with nothing and are their own component; vectors of
different lengths compare as if the shorter were padded with zeros; rows that repeat an id
and vector link to one another and count as separate rows; rows with a null id take part
and get the smallest non-null id of their component, with kept false; labels of any type
are compared as they are; further columns of the table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._graph import components
from tidewheel.llm._session import cut, partitions
from tidewheel.llm._skew import attach
from tidewheel.llm.simhash import forest

#: Principal coordinates of the grid; vectors in a block; rows compared by one product; guests a host meets in one task.
AXES, BLOCK, LEAF, GUESTS = 6, 1024, 256, 64
#: Slack for rounding in bounds.
SLACK = 1e-9
#: Dimensions up to which the whole scatter matrix is summed; beyond, passes over a subspace of AXES + SPARE.
FULL_SCATTER, SPARE, PASSES = 512, 6, 4


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usable(vector: str):
    """Not null, not zero, no null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """(AXES, dim) leading eigenvectors of the covariance over all vectors.  Sums are added per
    partition, then in groups of partitions, then here.  Up to FULL_SCATTER dimensions the
    scatter matrix is summed in one pass; beyond, a subspace of bounded width is iterated."""
    m, size = min(dim, AXES + SPARE), (dim * dim if dim <= FULL_SCATTER else dim * min(dim, AXES + SPARE))

    def passed(basis: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray] | None:
        """(n, mean, covariance times the basis, or the covariance)."""

        def scatter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            n, total, square = 0, np.zeros(dim), 0.0
            for frame in frames:
                for at in range(0, len(frame), 4096):
                    x = _unit(_matrix(frame["vec"].iloc[at : at + 4096], dim))
                    n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ (x if basis is None else x @ basis)
            if n:
                yield pd.DataFrame([(TaskContext.get().partitionId() % 64, np.concatenate(([n], total, square.ravel())).tobytes())], columns=["g", "sums"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(sum(np.frombuffer(b) for b in pdf["sums"]).tobytes(),)], columns=["sums"])

        rows = classes.select("vec").mapInPandas(scatter, "g long, sums binary").groupBy("g").applyInPandas(add, "sums binary").collect()
        if not rows:
            return None
        total = sum(np.frombuffer(r["sums"]) for r in rows)
        mean, square = total[1 : dim + 1] / total[0], total[dim + 1 :].reshape(dim, -1) / total[0]
        return total[0], mean, square - np.outer(mean, mean if basis is None else mean @ basis)

    if dim <= FULL_SCATTER:
        found = passed(None) if size else None
        if found is None:
            return np.zeros((0, dim))
        return np.ascontiguousarray(np.linalg.eigh(found[2])[1][:, ::-1].T[:AXES])
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, m)))[0]
    for turn in range(PASSES):
        found = passed(basis)
        if found is None:
            return np.zeros((0, dim))
        if turn == PASSES - 1:  # the subspace's own eigenvectors
            inside = basis.T @ found[2]
            return np.ascontiguousarray((basis @ np.linalg.eigh((inside + inside.T) / 2)[1][:, ::-1]).T[:AXES])
        basis = np.linalg.qr(found[2])[0]


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Distance between the bounding boxes of two sets of points."""
    gap = np.maximum(0.0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(np.sqrt((gap * gap).sum()))


def join_intervals(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, least: float, epsilon: float, ia: int = 0, ib: int = 0, same: bool = False):
    """Yield (rows of a, rows of b) of unit vectors with a dot product of at least ``least``;
    pa and pb are their grid coordinates.  ``same``: a is b, each pair once."""
    if not same and _apart(pa, pb) > epsilon:
        return
    if len(a) <= LEAF and len(b) <= LEAF:
        i, j = np.nonzero(a @ b.T >= least)
        if same:
            i, j = i[i < j], j[i < j]
        yield i + ia, j + ib
        return
    if same:
        h = len(a) // 2
        yield from join_intervals(a[:h], a[:h], pa[:h], pa[:h], least, epsilon, ia, ib, True)
        yield from join_intervals(a[h:], a[h:], pa[h:], pa[h:], least, epsilon, ia + h, ib + h, True)
        yield from join_intervals(a[:h], a[h:], pa[:h], pa[h:], least, epsilon, ia, ib + h)
    elif len(a) >= len(b):
        h = len(a) // 2
        yield from join_intervals(a[:h], b, pa[:h], pb, least, epsilon, ia, ib)
        yield from join_intervals(a[h:], b, pa[h:], pb, least, epsilon, ia + h, ib)
    else:
        h = len(b) // 2
        yield from join_intervals(a, b[:h], pa, pb[:h], least, epsilon, ia, ib)
        yield from join_intervals(a, b[h:], pa, pb[h:], least, epsilon, ia, ib + h)


def _blocks(classes: DataFrame, dim: int, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Rows in grid order with their block: (block, label, node, n, unit, place)."""
    k = len(axes)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _unit(_matrix(frame["vec"], dim))
            at = x @ axes.T
            out = frame[["label", "node", "n"]].assign(unit=[r.tobytes() for r in x], place=[r.tobytes() for r in at])
            for d in range(k):
                out[f"c{d}"] = np.floor(at[:, d] / epsilon).astype(np.int64)
            yield out

    cells = [f"c{d}" for d in range(k)]
    shape = "label string, node long, n long, unit binary, place binary"
    placed = classes.select("label", "node", "n", "vec").mapInPandas(place, shape + "".join(f", {c} long" for c in cells))
    order = ["label", *cells, "node"]
    spread = placed.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, filled, last = (TaskContext.get().partitionId() << 40) - 1, BLOCK, None
        for frame in frames:
            numbers = []
            for label in frame["label"]:
                if filled >= BLOCK or label != last:
                    block, filled, last = block + 1, 0, label
                filled += 1
                numbers.append(block)
            yield frame[["label", "node", "n", "unit", "place"]].assign(block=numbers)

    return cut(spread.mapInPandas(cut_up, shape + ", block long"))


def _block_pairs(rows: DataFrame, axes: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b: blocks of one label whose boxes are within epsilon."""

    def box(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            at = np.frombuffer(b"".join(frame["place"])).reshape(len(frame), -1)
            block = frame["block"].to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            yield pd.DataFrame({"block": block[begin], "label": frame["label"].to_numpy()[begin], "lo": list(np.minimum.reduceat(at, begin)), "hi": list(np.maximum.reduceat(at, begin))})

    part = rows.select("block", "label", "place").mapInPandas(box, "block long, label string, lo array<double>, hi array<double>")
    ends = [F.min(F.col("lo")[d]).alias(f"lo{d}") for d in range(axes)] + [F.max(F.col("hi")[d]).alias(f"hi{d}") for d in range(axes)]
    boxes = cut(part.groupBy("block", "label").agg(*ends))
    # a block stands in every cell of its leading coordinates, and in the next one up; blocks are
    # narrow in as many of these as it takes for there to be so many
    lead = range(max(1, min(axes, 4, int(math.log(max(1, boxes.count()), 6)))))
    for d in lead:
        boxes = boxes.withColumn(f"first{d}", F.floor(F.col(f"lo{d}") / epsilon)).withColumn(f"last{d}", F.floor(F.col(f"hi{d}") / epsilon) + 1)
    for d in lead:
        boxes = boxes.withColumn(f"cell{d}", F.explode(F.sequence(f"first{d}", f"last{d}")))
    boxes = cut(boxes)
    a, b = boxes.alias("a"), boxes.alias("b")
    gaps = [F.greatest(F.lit(0.0), F.col(f"a.lo{d}") - F.col(f"b.hi{d}"), F.col(f"b.lo{d}") - F.col(f"a.hi{d}")) for d in range(axes)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon
    met = (F.col("a.label") == F.col("b.label")) & (F.col("a.block") <= F.col("b.block"))
    for d in lead:  # once: in the first cell that both stand in
        met = met & (F.col(f"a.cell{d}") == F.col(f"b.cell{d}")) & (F.col(f"a.cell{d}") == F.greatest(f"a.first{d}", f"b.first{d}"))
    return a.join(b, met & near).select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))


def links(classes: DataFrame, dim: int, least: float) -> DataFrame:
    """(label, node, n, vec) -> rows of (node, other, n): with other null, n more rows link
    to node; else an edge of a spanning forest."""
    epsilon = math.sqrt(max(0.0, 2.0 - 2.0 * least)) + SLACK
    axes = principal_axes(classes, dim)
    shape = "node long, other long, n long"
    if not len(axes):
        return classes.sparkSession.createDataFrame([], shape)
    rows = _blocks(classes, dim, axes, epsilon)
    pairs = _block_pairs(rows, len(axes), epsilon)
    # either block of a pair hosts it, by parity, so that hosts are evenly loaded
    even = (F.col("a") + F.col("b")) % 2 == 0
    pairs = cut(pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("block")))
    guests = pairs.groupBy("host").agg(F.count("*").alias("guests"))
    group = F.pmod(F.xxhash64("block"), F.ceil(F.col("guests") / F.lit(GUESTS))).cast("int").alias("part")
    guests = pairs.join(guests, "host").select("host", group, F.lit(1).alias("side"), "block")
    hosts = guests.select("host", "part").distinct().select("host", "part", F.lit(0).alias("side"), F.col("host").alias("block"))
    sent = hosts.unionByName(guests).join(rows, "block").select("host", "part", "side", "block", "node", "n", "unit", "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home: list = [None, None, None, None, None]  # host, nodes, n, unit, place

        def arrays(frame: pd.DataFrame) -> tuple:
            stack = lambda c: np.frombuffer(b"".join(frame[c])).reshape(len(frame), -1)
            return frame["node"].to_numpy(), frame["n"].to_numpy(), stack("unit"), stack("place")

        def close(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            host, side, block = frame["host"].iloc[0], frame["side"].iloc[0], frame["block"].iloc[0]
            if side == 0:
                home[:] = [host, *arrays(frame)]
                return
            _, nodes, n, unit, place = home
            same = host == block
            nodes_b, n_b, unit_b, place_b = (nodes, n, unit, place) if same else arrays(frame)
            more, more_b, edges = np.zeros(len(nodes), np.int64), np.zeros(len(nodes_b), np.int64), []
            shift = 0 if same else len(nodes)

            def found():
                for i, j in join_intervals(unit, unit_b, place, place_b, least, epsilon, same=same):
                    if len(i):
                        np.add.at(more, i, n_b[j])
                        np.add.at(more if same else more_b, j, n[i])
                        yield i, j + shift

            edges = forest(len(nodes) + (0 if same else len(nodes_b)), found())
            every = nodes if same else np.concatenate((nodes, nodes_b))
            total = more if same else np.concatenate((more, more_b))
            hit = np.flatnonzero(total)
            if len(hit):
                yield pd.DataFrame({"node": every[hit], "other": None, "n": total[hit]}).astype({"other": "Int64"})
                at = np.array(edges, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"node": every[at[:, 0]], "other": every[at[:, 1]], "n": 0}).astype({"other": "Int64"})

        held: list[pd.DataFrame] = []
        last = None
        for frame in frames:
            keys = frame[["host", "part", "side", "block"]].to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
            for at, to in zip(begin, [*begin[1:], len(frame)]):
                key = tuple(keys[at])
                if last is not None and key != last:
                    yield from close(pd.concat(held))
                    held = []
                held.append(frame.iloc[at:to])
                last = key
        if held:
            yield from close(pd.concat(held))

    order = ["host", "part", "side", "block", "node"]
    return cut(sent.repartition("host", "part").sortWithinPartitions(*order).mapInPandas(run, shape))


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    ok = usable("vec") & F.col("label").isNotNull()
    # two 64-bit hashes with different seeds name a class of identical vectors of a label
    sound = base.where(ok).withColumn("h1", F.xxhash64("label", "vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec", "label"))
    named = ["label", "h1", "h2"]
    classes = sound.groupBy(*named).agg(F.min("id").alias("low"), F.count("*").alias("n"), F.any_value("vec").alias("vec"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    dim, total = classes.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = links(classes, dim, least)
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("others"))
    where = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select(*named, "node", "low", "n").join(counts, "node", "left").join(where, "node", "left")
    known = cut(known.withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("n") - 1))
    single = known.where("component is null").select(*named, "n", "n_links", F.col("low").alias("component_id"))
    linked = known.where("component is not null")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes"))
    linked = attach(linked, lowest, ["component"], "nodes", linked.count()).select(*single.columns)
    members = attach(sound.select("id", *named), linked.unionByName(single), named, "n", total).select("id", "n_links", "component_id")
    alone = base.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = members.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
