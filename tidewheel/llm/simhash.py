"""SimHash near-duplicate classes.

Fingerprints: one Arrow-batched pass over whole texts.  Equal fingerprints collapse to
one row first, so exact copies never meet in a comparison.  Candidates come from the
pigeonhole principle: cut 64 bits into m blocks, and two fingerprints within the radius
agree on at least m - radius of them; every such choice of blocks is a bucket key.  m
grows with the number of distinct fingerprints so that buckets stay small, and buckets
beyond ``BLOCK`` rows are dealt out as pairs of sub-buckets: nothing is capped.

Inside a bucket the comparison is bit-sliced: bit planes are stored vertically, each query
XORs a plane with all its bits broadcast and adds it to carry-save counters for 512
fingerprints at a time; a block is abandoned once every counter in it exceeds the radius.
A bucket emits a spanning forest of its links, never all pairs.

Defined cases: null or wordless text has fingerprint zero, which links like any other;
fewer words than a shingle give one shingle of all words; rows with a null id get a
fingerprint and the smallest non-null id of their class (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._graph import components
from tidewheel.llm._session import cut
from tidewheel.llm._skew import attach

BLOCK = 4096
PACK = 512
#: Keys of rows that go, up to which they are broadcast (24 bytes of content each).
BROADCAST_KEYS = 1_000_000
LANES = 8  # uint64 words per block of the kernel: 512 fingerprints
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 32768):
        to = min(n, at + 32768)
        pairs = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        h = np.fromiter((digest(joined[s:e], 42) for s, e in pairs), np.uint64, to - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", width: int = 4) -> DataFrame:
    """(id, fp long): fp holds the unsigned fingerprint's bits."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.select(F.col(id_col), of("text").alias("fp"))


def _planes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertical bit planes (64, blocks, LANES) and the planes that differ anywhere, most balanced first."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    ones = bits.sum(axis=1, dtype=np.int64)
    blocks = -(-len(fps) // (64 * LANES))
    packed = np.zeros((64, blocks * LANES * 8), np.uint8)
    row = np.packbits(bits, axis=1, bitorder="little")
    packed[:, : row.shape[1]] = row
    order = np.argsort(np.abs(2 * ones - len(fps)), kind="stable")
    return packed.view(np.uint64).reshape(64, blocks, LANES), order[(ones[order] > 0) & (ones[order] < len(fps))]


def near_pairs(fps: np.ndarray, radius: int = 4, queries: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of uint64 fingerprints that differ in at most ``radius`` bits."""
    n = len(fps)
    if n < 2:
        return
    planes, order = _planes(fps)
    blocks, span, depth = planes.shape[1], 64 * LANES, max(1, radius.bit_length())
    column = np.arange(span)
    for first in range(0, n - 1, queries):
        query = np.arange(first, min(n, first + queries))
        mask = np.where((fps[query][None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), ONES, np.uint64(0))
        q, b = np.nonzero(np.arange(blocks)[None, :] >= (query // span)[:, None])
        # dead from the start: a fingerprint itself, those before it and the padding
        at = b[:, None] * span + column[None, :]
        out = (at <= query[q][:, None]) | (at >= n)
        dead = np.packbits(out, axis=1, bitorder="little").view(np.uint64)
        counter = [np.zeros_like(dead) for _ in range(depth)]
        for step, p in enumerate(order):
            carry = planes[p][b] ^ mask[p][q][:, None]
            for c in counter:
                c ^= carry
                carry &= ~c
            dead |= carry
            if step % 6 == 5 or step == len(order) - 1:
                dead |= _above(counter, radius)
                live = (dead != ONES).any(axis=1)
                if not live.all():
                    q, b, dead = q[live], b[live], dead[live]
                    counter = [c[live] for c in counter]
                if not len(q):
                    break
        if len(q):
            r, j = np.nonzero(np.unpackbits(~dead.view(np.uint8), axis=1, bitorder="little"))
            yield query[q[r]], b[r] * span + j


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bit set where the sliced counter exceeds the radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], ONES)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs over n nodes."""
    label, kept = np.arange(n), []
    for i, j in pairs:
        while len(i):
            li, lj = label[i], label[j]
            open_ = li != lj
            i, j, li, lj = i[open_], j[open_], li[open_], lj[open_]
            if not len(i):
                break
            # per higher label one hook to its lowest partner: hooks always point down, so no cycle
            high, low = np.maximum(li, lj), np.minimum(li, lj)
            by = np.lexsort((low, high))
            lead = by[np.concatenate(([True], high[by][1:] != high[by][:-1]))]
            kept.extend(zip(i[lead].tolist(), j[lead].tolist()))
            to = np.arange(n)
            to[high[lead]] = low[lead]
            while not np.array_equal(to, to[to]):
                to = to[to]
            label = to[label]
    return kept


def _schemes(distinct: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges of every bucket key, for the fewest blocks that keep buckets near BLOCK rows."""
    m = radius + 1
    while m < 16 and distinct >> (64 * (m - radius) // m) > BLOCK:
        m += 1
    edges = [64 * k // m for k in range(m + 1)]
    return [[(edges[k], edges[k + 1]) for k in chosen] for chosen in combinations(range(m), m - radius)]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(fp long), one row each -> (a, b): a spanning set of the links between them."""
    total = distinct.count()
    keys = []
    for number, ranges in enumerate(_schemes(total, radius)):
        parts = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in ranges]
        keys.append(F.struct(F.lit(number).alias("band"), F.xxhash64(*parts).alias("key")))
    banded = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.band", "k.key")
    large = banded.groupBy("band", "key").count().where(F.col("count") > BLOCK).withColumn("size", F.col("count"))
    # a large bucket's rows learn its size where they lie, before they are dealt out
    split = attach(banded, large, ["band", "key"], "size", total * len(keys), "left").withColumn("subs", F.ceil(F.coalesce("count", F.lit(1)) / F.lit(BLOCK)).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64("fp", "band"), F.col("subs")).cast("int"))
    dealt = split.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    dealt = dealt.select("fp", "band", "key", F.least("own", "with").alias("s"), F.greatest("own", "with").alias("t"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run(fps: np.ndarray) -> pd.DataFrame:
            fps = np.unique(fps)
            found = forest(len(fps), near_pairs(fps.view(np.uint64), radius))
            at = np.array(found, np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": fps[at[:, 0]], "b": fps[at[:, 1]]})

        held = np.empty(0, np.int64)  # whole buckets not yet compared, then the open one
        whole, last = 0, None
        for frame in frames:
            key = frame[["band", "key", "s", "t"]].to_numpy()
            fps = frame["fp"].to_numpy()
            ends = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
            base = len(held)
            if last is not None and (key[0] != last).any():
                whole = base
            held, last = np.concatenate((held, fps)), key[-1]
            begin = 0
            for end in ([whole] if whole else []) + [base + e for e in ends]:
                if end - begin >= PACK:
                    yield run(held[begin:end])
                    begin = end
                whole = end
            held, whole = held[begin:], max(0, whole - begin)
        if len(held):
            yield run(held)

    order = ["band", "key", "s", "t"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = 4, width: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, class_size."""
    prints = cut(fingerprints(docs, id_col, width))
    per = cut(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")))
    # only fingerprints with a link have a class beside themselves
    linked = cut(per.join(components(links(per.select("fp"), radius)).withColumnRenamed("node", "fp"), "fp"))
    whole = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("class_size"), F.count("*").alias("fps"))
    classes = attach(linked.select("fp", "n", "component"), whole, ["component"], "fps", linked.count())
    columns = ["fp", "component_id", "class_size", "n"]
    single = per.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"), F.col("n").alias("class_size"), "n")
    found = attach(prints, classes.select(*columns).unionByName(single), ["fp"], "n", prints.count())
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One document of every class: that of the smallest id, null ids last.  Rows that share
    this id are told apart by digests of their content, and of equal rows one stays.

    Rows are told to go by key: while the keys that go (and those of repeated rows) fit a
    broadcast, texts are read where they lie and never shuffled."""
    text, whole = F.unhex(F.md5(F.coalesce("text", F.lit("")))), F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])
    key = F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), text.alias("text"), whole.alias("whole"))
    per = near_duplicates(docs.select(key.alias("__tw_key"), "text"), "__tw_key", **how)
    leads = (F.col("__tw_key.text") == F.col("component_id.text")) & (F.col("__tw_key.whole") == F.col("component_id.whole"))
    marks = per.groupBy(F.col("__tw_key.text").alias("__tw_text"), F.col("__tw_key.whole").alias("__tw_whole"))
    marks = cut(marks.agg(F.max(leads).alias("lead"), F.count("*").alias("n")).where("not lead or n > 1"))
    goes, repeats = marks.where("not lead").drop("lead", "n"), marks.where("lead").drop("lead", "n")
    count, again = marks.agg(F.count("*"), F.count(F.when(F.col("lead"), 1))).first()
    small = F.broadcast if count <= BROADCAST_KEYS else (lambda keys: keys)
    held = docs.select(F.struct("*").alias("__tw_row"), text.alias("__tw_text"), whole.alias("__tw_whole"))
    named = ["__tw_text", "__tw_whole"]
    single = held.join(small(marks.select(*named) if again else goes), named, "left_anti").select("__tw_row.*")
    if not again:
        return single
    first = held.join(small(repeats), named, "left_semi").groupBy(*named).agg(F.first("__tw_row").alias("__tw_row"))
    return single.unionByName(first.select("__tw_row.*"))
