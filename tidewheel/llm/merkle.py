"""A Merkle manifest of a table: a tree per source, a tree over the sources, a proof per row.

Trees grow by streaming aligned append.  A node that is appended gets a partial witness, its
siblings so far; each sibling completed later extends the witnesses of those before it; a run of
``FAN`` closes into a parent that is appended to the level above, where it gets a witness of its
own.  The work is dealt in aligned blocks of FAN^DEPTH consecutive leaves, each closed by one task
into a block root, and block roots are further appends: to the next level's blocks, until a source
has one node left, then to the tree over the sources.  On the way back every block's witness
extends those of its nodes, down to the rows, which fold their digests up to the root.

Rows are dealt by range of (source, id, digest), so a source of any size lies in many tasks, and a
task streams aligned blocks out of its range; only the pieces of blocks that reach over two ranges
are shuffled again.  A level has one row for FAN^DEPTH of the level below.  Witnesses of a block
are held once for all its rows and are nowhere gathered: per level they take FAN - 1 digests.  The
driver sees a few numbers per range and the root.

Defined cases: a null field is told apart from an empty one by its leaf; a null source is one of
its own and comes first; null ids come first, rows that share an id in order of their digests,
equal rows one after another with a leaf each; rows with a null id are never tampered with; an
empty table has no row and no root; texts of any length are digested whole; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._session import cut, partitions

FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: bytes) -> bytes:
    """sha256 of digests given one after another, as lowercase hex text."""
    return hashlib.sha256(parts.hex().encode()).digest()


class Witness:
    """A node's siblings, left and right, and its parent's witness once the run is closed."""

    __slots__ = ("before", "after", "parent")

    def __init__(self, before: list[bytes]):
        self.before, self.after, self.parent = before, [], None

    def path(self) -> bytes:
        """Level by level: the numbers of siblings to the left and right, then the siblings."""
        out, at = [], self
        while at.parent is not None:
            out.append(bytes((len(at.before), len(at.after))) + b"".join(at.before) + b"".join(at.after))
            at = at.parent
        return b"".join(out)


class Tree:
    """A block that grows by appends; ``close`` completes it to one node and returns its digest."""

    def __init__(self):
        self.open: list[list[tuple[bytes, Witness]]] = [[]]

    def append(self, node: bytes, level: int = 0) -> Witness:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        witness = Witness([d for d, _ in run])
        for _, earlier in run:
            earlier.after.append(node)
        run.append((node, witness))
        if len(run) == FAN:
            self._up(level)
        return witness

    def _up(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = self.append(digest(b"".join(d for d, _ in run)), level + 1)
        for _, witness in run:
            witness.parent = parent

    def close(self, levels: int | None) -> bytes:
        """Up to ``levels`` levels above the leaves; None: until one node is left."""
        level = 0
        while level != levels and (levels is not None or level + 1 < len(self.open) or len(self.open[level]) > 1):
            if self.open[level]:
                self._up(level)
            level += 1
        return self.open[level][0][0]


def grown(nodes: bytes, block: int) -> tuple[bytes, list[Witness]]:
    """(root, witnesses) of one block.  All but a lone first block go DEPTH levels up: a full
    first one does so either way."""
    tree = Tree()
    witnesses = [tree.append(nodes[at : at + SIZE]) for at in range(0, len(nodes), SIZE)]
    return tree.close(DEPTH if block or len(nodes) == SIZE * BLOCK else None), witnesses


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node and a path lead to."""
    at = 0
    while at < len(path):
        left, right = at + 2 + SIZE * path[at], SIZE * path[at + 1]
        node = digest(path[at + 2 : left] + node + path[left : left + right])
        at = left + right
    return node


def siblings(path: bytes) -> bytes:
    parts, at = [], 0
    while at < len(path):
        to = at + 2 + SIZE * (path[at] + path[at + 1])
        parts.append(path[at + 2 : to])
        at = to
    return b"".join(parts)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of fields, each as its bytes' number, a colon and its value, or - if null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


SHAPE = "key string, block long, at int, payload {payload}, nodes binary, others binary"


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(kind), pa.binary(), pa.binary())
    names = [c.split()[0] for c in SHAPE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string()}[kind]


def _closed(pieces: DataFrame, kind: str) -> DataFrame:
    """Pieces of blocks put together, each block with its root."""
    spark = pieces.sparkSession
    dealt = pieces.repartition(partitions(spark, 8), "key", "block").sortWithinPartitions("key", "block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def joined() -> tuple:
            return (*held[0][:3], [p for r in held for p in r[3]], b"".join(r[4] for r in held), b"".join(r[5] for r in held))

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    out.append(joined())
                    held = []
                held.append(row)
            if out:
                yield _batch(out, _arrow(kind))
        if held:
            yield _batch([joined()], _arrow(kind))

    return dealt.mapInArrow(run, SHAPE.format(payload=f"array<{kind}>"))


def _roots(blocks: DataFrame) -> DataFrame:
    """Blocks with the column ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [grown(nodes, block)[0] for block, nodes in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "root"])

    kind = dict(blocks.dtypes)["payload"]
    return cut(blocks.mapInArrow(run, SHAPE.format(payload=kind) + ", root binary"))


def _aligned(leaves: DataFrame, order: Sequence[str], kind: str) -> DataFrame:
    """(key, payload, node, other) in the order of ``order`` within a key -> whole blocks.

    Ranges are counted first: what a range's first key has in earlier ranges is where its stream
    begins.  Blocks that may reach into another range are pieces, and are put together."""
    spark = leaves.sparkSession
    by = ["key", *order, "_row"]
    dealt = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark, 8), *by).sortWithinPartitions(*by)
    ranges = cut(dealt.select("key", "payload", "node", "other", F.spark_partition_id().alias("range")))
    counts = ranges.groupBy("range", "key").agg(F.count("*").alias("n"))
    ends = counts.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("n", "key").alias("n")).orderBy("range").collect()  # a row per range
    offsets, key, n = {}, None, 0
    for r in ends:
        offsets[r["range"]] = n if r["first"] == key else 0
        n = r["n"] + (n if r["first"] == r["last"] == key else 0)
        key = r["last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, piece, out = None, 0, [], []

        def done(begin: int, whole: bool) -> None:
            out.append((key, begin // BLOCK, -1 if whole and begin % BLOCK == 0 else begin % BLOCK, [p for p, _, _ in piece], b"".join(x for _, x, _ in piece), b"".join(x for _, _, x in piece)))
            piece.clear()

        for batch in batches:
            for now, payload, node, other, number in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if piece:
                        done(at - len(piece), True)
                    at, key = offsets[number] if key is None else 0, now
                piece.append((payload, node, other))
                at += 1
                if at % BLOCK == 0:
                    done(at - len(piece), True)
            if out:
                yield _batch(out, _arrow(kind))
                out.clear()
        if piece:
            done(at - len(piece), False)  # the next range may go on with it
        if out:
            yield _batch(out, _arrow(kind))

    found = cut(ranges.mapInArrow(run, SHAPE.format(payload=f"array<{kind}>")))
    return found.where("at = -1").unionByName(_closed(found.where("at >= 0"), kind))


def _levels(lowest: DataFrame) -> list[DataFrame]:
    """Blocks level by level, until each key has one."""
    levels = [_roots(lowest)]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        nodes = levels[-1].select("key", F.expr(f"block div {BLOCK}").alias("block"), (F.col("block") % BLOCK).cast("int").alias("at"), F.array(F.col("block")).alias("payload"), F.col("root").alias("nodes"), F.lit(b"").alias("others"))
        levels.append(_roots(_closed(nodes, "long")))
    return levels


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes of blocks, their witnesses extended by their block's: (key, payload, path, node, subroot)."""
    met = blocks.join(above, ["key", "block"]).select("key", "block", "payload", "nodes", "path", "subroot")
    kind = dict(blocks.dtypes)["payload"].removeprefix("array<").removesuffix(">")
    arrow = _arrow({"bigint": "long"}.get(kind, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, payload, nodes, path, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                paths = [w.path() + path for w in grown(nodes, block)[1]]
                columns = ([key] * len(paths), payload, paths, [nodes[at : at + SIZE] for at in range(0, len(nodes), SIZE)], [subroot] * len(paths))
                kinds = (pa.string(), arrow, pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "payload", "path", "node", "subroot"])

    return met.mapInArrow(run, f"key string, payload {kind}, path binary, node binary, subroot binary")


def _witnesses(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The witness of every lowest block, from that of each key's last one."""
    for blocks in reversed(levels[1:]):
        above = cut(_descend(blocks, above).select("key", F.col("payload").alias("block"), "path", "subroot"))
    return above


def manifest(docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS) -> tuple[list[DataFrame], DataFrame, bytes | None]:
    """(levels of blocks, witness per lowest block, root).  ``changed``: a row's text as it is now, where
    that is not what it was; its digest goes along with the leaf."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("payload"), F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0")).alias("key"), leaf([F.col(c) for c in fields]).alias("node"), (leaf([changed if c == "text" else F.col(c) for c in fields]) if changed is not None else F.lit(b"")).alias("other"))
    levels = _levels(_aligned(cut(rows), ["payload", "node"], "long"))
    tops = levels[-1].select(F.lit("").alias("key"), F.col("key").alias("payload"), F.col("root").alias("node"), F.lit(b"").alias("other"))
    over = _levels(_aligned(tops, ["payload"], "string"))
    root = over[-1].select("root").first()
    if root is None:
        return levels, spark.createDataFrame([], "key string, block long, path binary, subroot binary"), None
    top = spark.createDataFrame([("", 0, b"", b"")], "key string, block long, path binary, subroot binary")
    subroots = _descend(over[0], _witnesses(over, top)).select(F.col("payload").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"))
    return levels, _witnesses(levels, cut(subroots)), bytes(root[0])


def tampered(id_col: str = "doc_id", text: str = "text", every: int = 5) -> Column:
    """The text with A-Z lower-cased where ``every`` divides the id's CRC-32, else as it is."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % every == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))


def audit(docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", **how) -> DataFrame:
    """Every row's leaf, subroot and root, the digest of its proof, the root its present text folds
    to, and whether that is the root."""
    levels, above, root = manifest(docs, F.col("text") if changed is None else changed, id_col, **how)
    met = levels[0].join(above, ["key", "block"]).select("block", "payload", "nodes", "others", "path", "subroot")
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, nodes, others, path, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for k, witness in enumerate(grown(nodes, block)[1]):
                    whole, at = witness.path() + path, slice(SIZE * k, SIZE * k + SIZE)
                    folded = fold(others[at], whole)
                    rows.append((payload[k], nodes[at].hex(), subroot.hex(), root.hex(), digest(siblings(whole)).hex(), folded.hex(), folded == root))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    shape = f"{id_col} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return met.mapInArrow(run, shape)


def root_of(nodes: Sequence[bytes]) -> bytes:
    """A tree's root from all its nodes at once: levels of runs of FAN until one is left."""
    nodes = list(nodes)
    while len(nodes) > 1:
        nodes = [digest(reduce(bytes.__add__, nodes[at : at + FAN])) for at in range(0, len(nodes), FAN)]
    return nodes[0]
