"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each quantised by a codebook of its own, so a pair of
centroids names a cell.  A query scores the centroids of either half and walks the pairs by
ascending summed distance (here: summed negated inner product) with a heap until the cells
it has met hold enough vectors; the vectors in those cells are reranked by the exact inner
product.  The heap holds pairs of runs of centroids in order of distance, so a step costs a
run by a run of cell sizes and pairs beyond the end of the walk are never looked at.

How many vectors are enough is measured, not assumed: about ``CALIBRATION`` of the queries
themselves, drawn by hash of the id, are compared with all rows, and the walk's length is the
shortest at which the share of true neighbours met, averaged over them and less two standard
errors, reaches ``RECALL``.  It adapts to the data: clustered vectors need a small part of the
table, isotropic ones a large part at any size, and where groups of copies stand beside single
vectors, the queries asked settle which of them counts.

The walk needs only the cells' sizes, a table bounded by the codebooks.  It ends at a
bound on the summed distance, and the query visits the shards that hold cells within it,
carrying just its vector and the bound.

Codebooks are fitted to a bounded sample (about ``SAMPLE_ROWS`` vectors, by hash of the id);
every row is indexed.  Cells in order fill shards of up to ``SHARD_BYTES``; a cell that reaches
over several is dealt over them, and all its queries visit each, so no cell has to fit one
task.  A task holds one shard's vectors and streams the queries past it in batches: where a
batch has met most of a shard one matrix product scores it, else only the cells met are.

Of identical vectors only the k + 1 smallest distinct ids can be in an answer (ties go to the
smaller id), so only those are stored, each once with the number of its rows: exact, and a
group of copies of any size costs k + 1 rows.

Defined cases: vectors that are null, zero or hold null or non-finite components, or have
a null id, take no part as query or candidate; repeated rows are candidates each, but ask once;
rows that share an id and differ in the vector ask once each, each with ranks from 1; vectors
of different lengths compare as if the shorter were padded with zeros; rows that share a
query's id are not its candidates; fewer candidates than k give fewer rows; further columns
of the table are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm._session import cut, partitions
from tidewheel.llm.embedding_dedup import _matrix, usable

SAMPLE_ROWS, ROUNDS = 20_000, 12
#: Bytes of a shard's vectors at most (fewer while that leaves under SPREAD shards).
SHARD_BYTES, SPREAD = 16 << 20, 24
#: Centroids of a half: twice the square root of the rows, at most this many.
CENTROIDS = 1024
#: Share of their true neighbours that the calibrating queries (about so many) must meet.
RECALL, CALIBRATION = 0.955, 256
#: Groups of shards whose lists are merged first; runs of centroids of a half in a walk.
GROUPS, RUNS = 64, 16
#: Queries past a shard at once; part of a shard met from which it is scored whole.
BATCH, DENSE = 256, 0.05


def quantiser(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means centroids (at most as many as there are points), seeded by k-means++ draws."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = [points[rng.integers(len(points))]]
    far = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = far.sum()
        pick = rng.integers(len(points)) if total <= 0 else min(int(np.searchsorted(np.cumsum(far), rng.random() * total)), len(points) - 1)
        centres.append(points[pick])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(rounds):
        of = np.concatenate([nearest(points[at : at + 4096], centres) for at in range(0, len(points), 4096)])
        n = np.bincount(of, minlength=k)
        for d in range(points.shape[1]):
            sums = np.bincount(of, weights=points[:, d], minlength=k)
            centres[:, d] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, d])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2.0 * points @ centres.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[float, int]]:
    """The multi-sequence walk: (summed distance reached, rows held so far), run pair by run pair.

    Either half's centroids, in order of distance, are cut into runs.  The heap holds pairs
    of runs by the distance of their nearest pair of centroids; the nearest is taken, counted
    and replaced by its neighbours.  When a distance is reached, every cell below it has been
    counted."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    runs_a, runs_b = np.array_split(a, min(RUNS, len(a))), np.array_split(b, min(RUNS, len(b)))
    x, y = [float(first[r[0]]) for r in runs_a], [float(second[r[0]]) for r in runs_b]
    heap, held = [(x[0] + y[0], 0, 0)], 0
    while heap:
        near, i, j = heapq.heappop(heap)
        more = int(sizes[runs_a[i][:, None], runs_b[j]].sum())
        held += more
        if not j and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if more or not heap:
            yield near if heap else np.inf, held


def bound(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> float:
    """The summed distance at which the walk has held ``enough`` rows."""
    for reached, held in walk(first, second, sizes):
        if held >= enough:
            return reached
    return np.inf


def needed(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Rows a walk must hold before each of the cells is within its bound."""
    steps = np.array(list(walk(first, second, sizes)))
    i, j = np.divmod(cells, len(second))
    return steps[np.searchsorted(steps[:, 0], first[i] + second[j]), 1].astype(np.int64)


def best(scores: np.ndarray, met: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a (queries, rows) product where ``met``: (query numbers, row numbers, scores) of each
    query's k best, ties to the smaller id.  The product finds who may be among them; their
    scores are then summed row by row, so equal vectors score equally wherever they stand."""
    scores = np.where(met, scores, -np.inf)
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        with np.errstate(invalid="ignore"):
            q, r = np.nonzero(met & (scores >= np.where(np.isfinite(kth), kth - 1e-9 * (1.0 + np.abs(kth)), -np.inf)))
    else:
        q, r = np.nonzero(met)
    exact = (vectors[r] * queries[q]).sum(axis=1)
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k], exact[place < k]


def _true_cells(placed: DataFrame, asked: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """(query number, cell) of the k nearest of each of a few queries, by a scan of all rows."""
    shared = placed.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), _matrix(asked["vec"], width)))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, queries = shared.value
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                ids, x = part["id"].to_numpy(), _matrix(part["vec"], width)
                q, r, exact = best(queries @ x.T, own[:, None] != ids[None, :], queries, x, ids, k)
                yield pd.DataFrame({"q": q, "score": exact, "id": ids[r], "cell": part["cell"].to_numpy()[r]})

    found = placed.select("id", "vec", "cell").mapInPandas(scan, "q int, score double, id long, cell long")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("q", "cell").toPandas()


def _enough(lengths: list[np.ndarray], recall: float, count: int) -> int:
    """The shortest walk at which the queries have met ``recall`` of their neighbours by their mean
    less two of its standard errors (``lengths``: per query, those that meet each neighbour); 1 walks
    everything."""
    if recall >= 1.0 or not lengths:
        return count
    lengths = [np.sort(of) for of in lengths]

    def reached(walk: int) -> bool:
        share = np.array([np.searchsorted(of, walk, side="right") / len(of) for of in lengths])
        return share.mean() - 2.0 * share.std() / len(share) ** 0.5 >= recall

    steps = np.unique(np.concatenate(lengths))
    low, high = 0, len(steps) - 1  # at the last step everything is met
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reached(int(steps[mid])) else (mid + 1, high)
    return int(steps[low])


def _by_hash(rows: DataFrame, share: float, *columns: str) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, share))))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for every
    row that ``is_query`` (a condition on ``id``) holds for.  ``recall`` is what the walk is
    calibrated to; 1 walks every cell."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull()).where(usable("vec"))
    hashed = base.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    each = hashed.groupBy("h1", "h2", "id").agg(F.any_value("vec").alias("vec"), F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))
    rows = each.withColumn("r", rank).where(F.col("r") <= k + 1)
    rows = cut(rows.select("id", "vec", F.least("n", F.lit(k)).cast("int").alias("n")))
    count, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not count:
        return spark.createDataFrame([], shape)
    half = (dim + 1) // 2
    sample = _by_hash(rows, SAMPLE_ROWS / count, "id").select("id", "vec").toPandas().sort_values("id", ignore_index=True)
    if not len(sample):
        sample = rows.select("id", "vec").limit(1).toPandas()
    points = _matrix(sample["vec"], 2 * half)
    centroids = int(min(CENTROIDS, max(2, round(2 * count**0.5))))
    books = quantiser(points[:, :half], centroids), quantiser(points[:, half:], centroids)
    shared = spark.sparkContext.broadcast(books)  # at most 2 * CENTROIDS * dim / 2 numbers
    wide = len(books[1])

    @F.pandas_udf("long")
    def cell_of(vecs: pd.Series) -> pd.Series:
        x, (a, b) = _matrix(vecs, 2 * half), shared.value
        return pd.Series(nearest(x[:, :half], a) * wide + nearest(x[:, half:], b)) if len(x) else pd.Series([], dtype=np.int64)

    placed = cut(rows.withColumn("cell", cell_of("vec")))
    sizes = np.zeros((len(books[0]), wide), np.int32)  # a number per cell: bounded by CENTROIDS squared
    held = placed.groupBy("cell").agg(F.count("*").alias("rows")).toPandas()
    sizes.ravel()[held["cell"].to_numpy()] = held["rows"].to_numpy()
    width = partitions(spark, 8)
    queries = hashed.where(is_query).groupBy("id", "h1", "h2").agg(F.any_value("vec").alias("vec")).select("id", "h1", "h2", "vec")
    asking = queries.count()
    if not asking:
        return spark.createDataFrame([], shape)
    asked = _by_hash(queries, CALIBRATION / asking, "id", "h1", "h2").select("id", "vec").toPandas().sort_values("id", ignore_index=True)  # bounded by CALIBRATION
    if not len(asked):
        asked = queries.select("id", "vec").limit(CALIBRATION).toPandas().sort_values("id", ignore_index=True)
    true = _true_cells(placed, asked, 2 * half, k)
    x = _matrix(asked["vec"], 2 * half)
    first, second = -x[:, :half] @ books[0].T, -x[:, half:] @ books[1].T
    lengths = [needed(first[q], second[q], sizes, part["cell"].to_numpy()) for q, part in true.groupby("q")]
    enough = _enough(lengths, recall, count)

    after = np.cumsum(sizes.ravel(), dtype=np.int64)
    rows_each = max(1, min(max(1024, SHARD_BYTES // (16 * half)), max(1024, count // SPREAD)))
    lowest, highest = ((after - sizes.ravel()) // rows_each).astype(np.int32), (np.maximum(after - 1, 0) // rows_each).astype(np.int32)
    grid = spark.sparkContext.broadcast((sizes, lowest, highest))

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series, cells: pd.Series) -> pd.Series:
        _, low, high = grid.value
        cells = cells.to_numpy()
        mixed = ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return pd.Series(low[cells] + (mixed % (high[cells] - low[cells] + 1).astype(np.uint64)).astype(np.int64))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (a, b), (sizes, low, high) = shared.value, grid.value
        last = int(high[-1]) + 2
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part, out = frame.iloc[at : at + BATCH], []
                x = _matrix(part["vec"], 2 * half)
                first, second = -x[:, :half] @ a.T, -x[:, half:] @ b.T
                for n, (query, h1, h2, vec) in enumerate(zip(part["id"], part["h1"], part["h2"], part["vec"])):
                    reach = bound(first[n], second[n], sizes, enough)
                    # cells within the bound: of each near centroid of the first half, a run of the second's
                    i, order = np.flatnonzero(first[n] + second[n].min() <= reach), np.argsort(second[n], kind="stable")
                    upto = np.searchsorted(second[n][order], reach - first[n][i], side="right")
                    within = np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)
                    met = np.repeat(i * wide, upto) + order[within]
                    met = met[sizes.ravel()[met] > 0]
                    begins = np.bincount(low[met], minlength=last) - np.concatenate(([0], np.bincount(high[met], minlength=last)[:-1]))
                    out += [(int(shard), 1, -1, query, h1, h2, vec, reach) for shard in np.flatnonzero(np.cumsum(begins) > 0)]
                yield pd.DataFrame(out, columns=["shard", "kind", "cell", "id", "h1", "h2", "vec", "bound"])

    # the work of a row is far larger than its bytes, by which partitions would be coalesced
    fields = "shard long, kind int, cell long, id long, h1 long, h2 long, vec array<double>, bound double"
    probes = queries.repartition(width, "id").mapInPandas(probe, fields).withColumn("n", F.lit(0))
    none = F.lit(0).cast("long")
    stored = placed.select(shard_of("id", "cell").alias("shard"), F.lit(0).alias("kind"), "cell", "id", none.alias("h1"), none.alias("h2"), "vec", F.lit(0.0).alias("bound"), "n")

    def rerank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value
        key, parts, held = None, [], None
        for frame in frames:
            marks = frame[["shard", "kind"]].to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], (marks[1:] != marks[:-1]).any(axis=1)))) if len(marks) else []
            for at, to in zip(begin, [*begin[1:], len(frame)]):
                part, (shard, kind) = frame.iloc[at:to], marks[at]
                if shard != key:
                    key, parts, held = shard, [], None
                if kind == 0:
                    parts.append((part["id"].to_numpy(), _matrix(part["vec"], 2 * half), part["cell"].to_numpy(), part["n"].to_numpy()))
                    continue
                if held is None:
                    held = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros((0, 2 * half)), np.zeros(0, np.int64), np.zeros(0, np.int64)]
                    cells, member = np.unique(held[2], return_inverse=True)
                    i, j = cells // wide, cells % wide
                ids, vectors, _, times = held
                for start in range(0, len(part), BATCH):
                    some = part.iloc[start : start + BATCH]
                    x, own = _matrix(some["vec"], 2 * half), some["id"].to_numpy()
                    near = (-(x[:, :half] @ a.T))[:, i] + (-(x[:, half:] @ b.T))[:, j] <= some["bound"].to_numpy()[:, None] + 1e-9
                    if near.mean() < DENSE:
                        found = [(n, *_one(near[n][member], x[n], own[n], vectors, ids, k)) for n in range(len(x))]
                    else:
                        q, r, exact = best(x @ vectors.T, near[:, member] & (own[:, None] != ids[None, :]), x, vectors, ids, k)
                        ends = np.searchsorted(q, np.arange(len(x) + 1))
                        found = [(n, r[u:v], exact[u:v]) for n, (u, v) in enumerate(zip(ends[:-1], ends[1:]))]
                    rows = [(own[n], some["h1"].iloc[n], some["h2"].iloc[n], shard % GROUPS, ids[r], times[r], exact) for n, r, exact in found]
                    yield pd.DataFrame(rows, columns=["query_id", "h1", "h2", "part", "ids", "times", "scores"])

    met = stored.unionByName(probes).repartition(width, "shard").sortWithinPartitions("shard", "kind", "cell")
    lists = met.mapInPandas(rerank, "query_id long, h1 long, h2 long, part int, ids array<long>, times array<int>, scores array<double>")
    # a query has a list of at most k a shard; the best k of several lists are in their union's.
    # Past GROUPS shards lists are merged in two steps, so that no row gathers them all.
    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        every = rows.groupBy(*keys).agg(F.flatten(F.collect_list("hits")).alias("all"))
        return every.select(*keys, F.slice(F.array_sort("all"), 1, k).alias("hits"))

    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("m"), F.col("ids").alias("id"), F.col("times").alias("n"))
    top = lists.select("query_id", "h1", "h2", "part", pairs.alias("hits"))
    if int(highest[-1]) >= GROUPS:
        top = merged(top, "query_id", "h1", "h2", "part")
    rowwise = F.flatten(F.transform("hits", lambda hit: F.array_repeat(hit, hit["n"])))  # repeated rows count each
    top = merged(top, "query_id", "h1", "h2").select("query_id", F.posexplode(F.slice(rowwise, 1, k)).alias("p", "hit"))
    return top.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.m")).alias("score"))


def _one(met: np.ndarray, query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, scores) of one query's k best among the rows met."""
    rows = np.flatnonzero(met & (ids != own))
    part = vectors[rows]
    _, r, exact = best((part @ query)[None, :], np.ones((1, len(rows)), bool), query[None, :], part, ids[rows], k)
    return rows[r], exact
