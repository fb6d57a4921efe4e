"""Token ids in binary files of directly addressable codes.

An id is cut into chunks, low bits first.  The first level of a file holds the first chunk of
every id, one after another in packed bits, and a bitmap that says which ids go on; the next
level holds the second chunks of those that do, and so on.  A rank directory counts the bitmap's
ones up to every 512th bit, so the place of an id on the next level is one counter and the ones
of a few words away: any token is read with a few bytes of each level, and no block is decoded.
The widths of the levels are those that make the file smallest, found from the lengths of its ids.

Documents are dealt by range of (id, digest of the text), so tasks hold consecutive stretches of
the corpus, and a task tokenizes and writes its stretch in one pass: ids never move, nor are they
kept in one piece.  A file takes up to ``FILE_TOKENS`` ids.  Its place in the order of all files is the
number of its range and its number there; what a file begins with follows from the totals of the
ranges before.  Files carry names of the attempt that wrote them and the manifest lists those that
count, so lost or repeated tasks leave nothing half-read.

Texts are tokenized by the tokenizers library.  For byte-level BPE behind its own pattern, texts are
split before every space, the pieces of many texts are counted as one each (Arrow), looked up among
those met before (bounded stores), and only the others go to the library, many at a time.  That is
exact, as a pre-token reaches over a space only in white space that goes on behind it; texts where
some does, and long pieces, are cut into runs with and without white space instead.  Texts
that hold an added token's string, and all texts for any other tokenizer, go there whole.

Defined cases: null text is empty, so a document of it holds the end id alone; null ids come last;
rows that share an id stand in order of their texts' digests, equal rows one after another; an
empty table writes no file; a document of any length lies in one file, which may exceed
FILE_TOKENS; further columns of the table are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm._files import opened, written
from tidewheel.llm._session import cut, fresh_folder, partitions

#: Fixed values of the format: magic, bits of the bitmap per counter of the rank directory.
MAGIC, STRIDE = b"DACIDS1\n", 512
#: Ids of a file; texts tokenized at once and their bytes (one text's at least); runs in each of two
#: stores, pieces in another, and the longest one stored.
FILE_TOKENS, ROWS, ROWS_BYTES, MEMO, PIECES, MEMO_CHARS = 8 << 20, 1024, 8 << 20, 450_000, 1_000_000, 64
#: Runs given to the library as one text.
JOINED = 1000
#: The characters with Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters in every version of Unicode, and marks that no pre-token shares with them.
LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f", ".,;:!?"
RUNS = re.compile(f" ?[{LETTERS}]++(?=[{SPACE}{MARKS}]|$)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space that may be in one pre-token with what is before it (for Arrow's expressions).
INSIDE = rf"[{SPACE}] (?:[{SPACE}]|\z)"
BITS = np.array([bin(b).count("1") for b in range(256)], np.int64)


class TextEncoder:
    """Texts to ids (little-endian unsigned 32-bit integers) as the tokenizers library has them."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        how = json.loads(self.library.to_str())
        before = how.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.by_runs = bool(plain and not how.get("normalizer") and how["model"]["type"] == "BPE")
        self.added = [t["content"] for t in how.get("added_tokens", [])]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.led = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space
        self.led[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # pieces without the space before them, by number; where the ids of each begin and end; when it was last met
        self.pieces: dict[str, int] = {}
        self.ids, self.ends, self.last, self.now = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of runs or pieces.  Those that begin with a space, no more white space behind it, are joined: each
        then begins where an id does that begins with a space, as it holds no other."""
        joint, lone = [], []
        for r in fresh:
            (joint if len(r) > 1 and r[0] == " " and not r[1].isspace() else lone).append(r)
        found = dict(zip(lone, self.whole(lone)))
        groups = [joint[at : at + JOINED] for at in range(0, len(joint), JOINED)]
        for group, ids in zip(groups, self.whole(["".join(g) for g in groups])):
            ids = np.frombuffer(ids, "<u4")
            begins = np.flatnonzero(self.led[ids])
            if len(begins) != len(group) or (len(begins) and begins[0]):
                found.update(zip(group, self.whole(group)))
                continue
            data, ends = ids.tobytes(), [*(begins[1:] * 4).tolist(), len(ids) * 4]
            found.update(zip(group, [data[a:b] for a, b in zip((begins * 4).tolist(), ends)]))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("")
        if not self.by_runs:
            return self.whole(texts.to_pylist())
        apart = np.zeros(len(texts), bool)
        for token in self.added:  # texts with added tokens are cut at them first
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = pc.match_substring_regex(texts, INSIDE).to_numpy(zero_copy_only=False) & ~apart
        out: list[bytes] = [b""] * len(texts)
        for which, how in ((apart, lambda t: self.whole(t.to_pylist())), (cut, lambda t: self._by_runs(t.to_pylist())), (~apart & ~cut, self._by_pieces)):
            if which.any():
                for k, data in zip(np.flatnonzero(which).tolist(), how(texts.filter(pa.array(which)))):
                    out[k] = data
        return out

    def _by_runs(self, texts: list[str]) -> list[bytes]:
        return [b"".join(ids) for ids in self._met([RUNS.findall(t) for t in texts])]

    def _by_pieces(self, texts: pa.Array) -> list[bytes]:
        """Every piece but a text's first has a space before it.  Equal ones are encoded once, then their ids are laid
        where they occur."""
        split = pc.split_pattern(texts, " ")
        at, pieces = split.offsets.to_numpy(), split.values.dictionary_encode()
        codes = pieces.indices.to_numpy()
        inner = np.ones(len(codes), bool)
        inner[at[:-1]] = False
        used = np.zeros(len(pieces.dictionary), bool)
        used[codes[inner]] = True
        table, begins, lengths = self._table(pieces.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        stored = len(lengths)
        firsts = self._by_runs(split.values.take(pa.array(at[:-1])).to_pylist())
        sizes = np.array([len(f) // 4 for f in firsts], np.int64)
        begins = np.concatenate((begins, len(table) + np.cumsum(sizes) - sizes))
        lengths, table = np.concatenate((lengths, sizes)), np.concatenate((table, np.frombuffer(b"".join(firsts), "<u4")))
        codes = (np.cumsum(used) - 1)[codes]
        codes[at[:-1]] = stored + np.arange(len(texts))
        begins, lengths = begins[codes], lengths[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        out = []
        for k in range(0, len(texts), 64):  # few enough for a cache
            a, b = at[k], at[min(k + 64, len(texts))]
            places = np.repeat(begins[a:b] - ends[a:b], lengths[a:b]) + np.arange(ends[a], ends[b])
            data, cuts = table[places].tobytes(), (4 * (ends[at[k : k + 65]] - ends[a])).tolist()
            out += [data[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        return out

    def _table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces with a space before them: a table, where each begins there and how many it has."""
        self.now += 1
        held = len(self.pieces)
        where = np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))
        new, long = [], []
        self.last[where[where >= 0]] = self.now
        for k in np.flatnonzero(where < 0).tolist():
            (new if len(pieces[k]) <= MEMO_CHARS else long).append(k)
        fresh = [" " + pieces[k] for k in new]
        learnt = self._learn(fresh)
        ids = [learnt[p] for p in fresh] + self._by_runs([" " + pieces[k] for k in long])
        table = np.concatenate((self.ids, np.frombuffer(b"".join(ids), "<u4")))
        ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)))
        where[new + long] = held + np.arange(len(ids))
        self.pieces.update(zip([pieces[k] for k in new], range(held, held + len(new))))
        self.last = np.concatenate((self.last, np.full(len(new), self.now)))
        self.ends = ends[: len(self.pieces) + 1]
        self.ids = table[: self.ends[-1]]
        if len(self.pieces) > PIECES:  # the half that was met last stays
            stays = np.zeros(len(self.pieces), bool)
            stays[np.argsort(self.last, kind="stable")[-(PIECES // 2) :]] = True
            sizes = np.diff(self.ends)
            self.ids, self.ends, self.last = self.ids[np.repeat(stays, sizes)], np.concatenate(([0], np.cumsum(sizes[stays]))), self.last[stays]
            self.pieces = {p: k for k, p in enumerate(compress(self.pieces, stays.tolist()))}
        return table, ends[where], ends[where + 1] - ends[where]

    def _met(self, held: list[list[str]]) -> list[list[bytes]]:
        """Ids of every run or piece, from the stores or the library."""
        parts = [list(map(self.memo.get, runs)) for runs in held]
        gaps = []
        for runs, ids in zip(held, parts):
            for at in range(ids.count(None)):
                at = ids.index(None, gaps[-1][1] + 1 if at else 0)
                gaps.append((ids, at, runs[at]))
        fresh = {run for _, _, run in gaps}
        learnt = {run: self.old[run] for run in fresh if run in self.old}
        learnt |= self._learn([run for run in fresh if run not in learnt])
        for ids, at, run in gaps:
            ids[at] = learnt[run]
        if len(self.memo) + len(learnt) > MEMO:  # what was met lately stays for a while
            self.old, self.memo = self.memo, {}
        short = max(map(len, learnt), default=0) <= MEMO_CHARS
        self.memo.update(learnt if short else {run: ids for run, ids in learnt.items() if len(run) <= MEMO_CHARS})
        return parts


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in order, up to ``ROWS`` of them with up to ``ROWS_BYTES`` of text, or one alone."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS_BYTES, "right"))
        to = min(at + ROWS, max(at + 1, full))
        yield batch.slice(at, to - at)
        at = to


def best_widths(lengths: np.ndarray) -> list[int]:
    """Widths of the levels that take the fewest bits, bitmaps and rank directories included, for
    ``lengths[b]`` ids of b bits: the cheapest way over the cuts between bits 0 and the longest."""
    most = max(1, int(np.flatnonzero(lengths)[-1])) if lengths.any() else 1
    over = [int(lengths[b + 1 :].sum()) if b else int(lengths.sum()) for b in range(most + 1)]  # ids that reach past bit b
    cost, way = [0.0] + [np.inf] * most, [0] * (most + 1)
    for to in range(1, most + 1):
        for at in range(max(0, to - 16), to):
            bitmap = over[at] * (1.0 + 64.0 / STRIDE) if to < most else 0.0
            if cost[at] + over[at] * (to - at) + bitmap < cost[to]:
                cost[to], way[to] = cost[at] + over[at] * (to - at) + bitmap, at
    widths, at = [], most
    while at:
        widths.append(at - way[at])
        at = way[at]
    return widths[::-1]


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits (of 16 at most) of every value, low bits first, without gaps: eight values
    fill as many whole bytes as they have bits."""
    parts, low, w = [], np.uint64((1 << width) - 1), np.uint64(width)
    for at in range(0, len(values), 1 << 18):
        v = values[at : at + (1 << 18)].astype(np.uint64) & low
        v = np.concatenate((v, np.zeros(-len(v) % 8, np.uint64))).reshape(-1, 8).T
        near, far = (v[k] | v[k + 1] << w | v[k + 2] << (w + w) | v[k + 3] << (w + w + w) for k in (0, 4))
        both = np.empty((len(near), 2), "<u8")
        both[:, 0] = near | far << np.uint64(4 * width) if width < 16 else near
        both[:, 1] = far >> np.uint64(64 - 4 * width) if width < 16 else far
        parts.append(both.view(np.uint8)[:, :width].tobytes())
    return b"".join(parts)


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    out, low = np.empty(-(-count // 8) * 8, np.uint32), np.uint64((1 << width) - 1)
    groups = np.frombuffer(data, np.uint8).reshape(-1, width)
    for at in range(0, len(groups), 1 << 15):
        part = groups[at : at + (1 << 15)]
        both = np.zeros((len(part), 16), np.uint8)
        both[:, :width] = part
        both = both.view("<u8")
        near = both[:, 0]
        far = near >> np.uint64(4 * width) | both[:, 1] << np.uint64(64 - 4 * width) if width < 16 else both[:, 1]
        held = out[8 * at : 8 * (at + len(part))].reshape(-1, 8)
        for k in range(4):
            held[:, k] = near >> np.uint64(k * width) & low
            held[:, k + 4] = far >> np.uint64(k * width) & low
    return out[:count]


def build(ids: np.ndarray) -> tuple[list[dict], list[bytes]]:
    """Levels of codes: what is said of each (width, count), and its chunks, bitmap and rank directory."""
    lengths = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=1)
    said, parts = [], []
    for k, width in enumerate(widths := best_widths(lengths)):
        last = k + 1 == len(widths)
        said.append({"width": width, "count": len(ids), "last": last})
        parts.append(pack(ids, width))
        rest = ids >> np.uint32(width)
        if not last:
            on = rest > 0
            bitmap = np.packbits(on, bitorder="little").tobytes()
            ones = np.add.reduceat(on, np.arange(0, len(on), STRIDE), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
            parts += [bitmap, np.concatenate(([0], np.cumsum(ones))).astype("<i8").tobytes()]
            ids = rest[on]
    return said, parts


def write_file(out, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    """Header (sizes and places of all parts), document ids, their starts, then the levels."""
    said, levels = build(ids)
    known = np.array([d is not None for d in doc_ids], bool)
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.packbits(known, bitorder="little").tobytes(),
        np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes(), *levels,
    ]
    head = json.dumps({"documents": len(doc_ids), "tokens": len(ids), "levels": said, "sizes": [len(p) for p in parts]}).encode()
    out.write(MAGIC + struct.pack("<I", len(head)) + head)
    for part in parts:
        out.write(part)


class TokenFile:
    """One file of codes, read through ``read(place, size)``: only what is asked for is fetched."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        first = read(0, len(MAGIC) + 4)
        if first[: len(MAGIC)] != MAGIC:
            raise ValueError("no file of token codes")
        size = struct.unpack("<I", first[len(MAGIC) :])[0]
        head = json.loads(read(len(first), size))
        self.documents, self.tokens, self.levels = head["documents"], head["tokens"], head["levels"]
        at, places = len(first) + size, []
        for n in head["sizes"]:
            places.append((at, n))
            at += n
        self.ids_at, self.known_at, self.starts_at, *rest = places
        for level in self.levels:
            level["chunks"], rest = rest[0], rest[1:]
            if not level["last"]:
                level["bitmap"], level["ranks"], rest = rest[0], rest[1], rest[2:]

    def doc_ids(self) -> list[int | None]:
        known = np.unpackbits(np.frombuffer(self.read(*self.known_at), np.uint8), count=self.documents, bitorder="little")
        return [int(d) if k else None for d, k in zip(np.frombuffer(self.read(*self.ids_at), "<i8"), known)]

    def starts(self) -> np.ndarray:
        return np.frombuffer(self.read(*self.starts_at), "<i8")

    def token(self, place: int) -> int:
        """The id at one place, from a few bytes of each level."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        value = shift = 0
        for level in self.levels:
            width, (at, _) = level["width"], level["chunks"]
            bit = place * width
            raw = int.from_bytes(self.read(at + bit // 8, (bit % 8 + width + 7) // 8), "little")
            value |= (raw >> bit % 8 & (1 << width) - 1) << shift
            shift += width
            if level["last"]:
                break
            stride, near = divmod(place, STRIDE)
            bits = self.read(level["bitmap"][0] + stride * STRIDE // 8, near // 8 + 1)
            if not bits[near // 8] >> near % 8 & 1:
                break
            before = struct.unpack("<q", self.read(level["ranks"][0] + 8 * stride, 8))[0]
            place = before + int(BITS[np.frombuffer(bits, np.uint8, near // 8)].sum()) + int(BITS[bits[near // 8] & (1 << near % 8) - 1])
        return value

    def every(self) -> np.ndarray:
        """All ids, level by level."""
        out, rows, shift = np.zeros(self.tokens, np.uint32), None, 0
        for level in self.levels:
            part = unpack(self.read(*level["chunks"]), level["width"], level["count"]) << np.uint32(shift)
            if rows is None:
                out |= part
            else:
                out[rows] |= part
            if not level["last"]:
                on = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(*level["bitmap"]), np.uint8), count=level["count"], bitorder="little"))
                rows = on if rows is None else rows[on]
            shift += level["width"]
        return out


def reader(source) -> Callable[[int, int], bytes]:
    """``read(place, size)`` over a seekable file."""

    def read(place: int, size: int) -> bytes:
        source.seek(place)
        return source.read(size)

    return read


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) -> manifest of the files written, in the order of the corpus: path, start (ids in
    the files before), documents, tokens.  ``tokenizer`` must be readable on every executor."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("h"), F.col("row")]  # the last only deals out equal rows
    dealt = rows.repartitionByRange(partitions(spark, 8), *order).sortWithinPartitions(*order).select("id", "text")
    names = ["range", "number", "path", "documents", "tokens"]
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = text_encoder(tokenizer), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.dac"
            with written(uri) as out:
                write_file(out, ids, [len(h) // 4 for h in held], np.frombuffer(b"".join(held), "<u4"))
            row = [[TaskContext.get().partitionId()], [number], [uri], [len(ids)], [size]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for part in slices(batch):
                for doc_id, data in zip(part.column(0).to_pylist(), encoder.encode_column(part.column(1))):
                    data += tail
                    if ids and size + len(data) // 4 > FILE_TOKENS:
                        yield flush()
                        ids, held, size, number = [], [], 0, number + 1
                    ids.append(doc_id)
                    held.append(data)
                    size += len(data) // 4
        if ids:
            yield flush()

    files = cut(dealt.mapInArrow(store, "range int, number int, path string, documents long, tokens long"))
    before, starts = 0, []
    for r in files.groupBy("range").agg(F.sum("tokens").alias("n")).orderBy("range").collect():  # a row per partition
        starts.append((r["range"], before))
        before += r["n"]
    bases = spark.createDataFrame(starts, "range int, base long")
    within = W.partitionBy("range").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return files.join(F.broadcast(bases), "range").select("path", start.alias("start"), "documents", "tokens")


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers) and, if asked for, the ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(path) as source:
                    file = TokenFile(reader(source))
                    doc_ids, starts, ids = file.doc_ids(), file.starts(), file.every().astype("<u4", copy=False)
                raw = memoryview(ids).cast("B")
                for at in range(0, len(doc_ids), 4096):
                    ends = starts[at : at + 4097].tolist()
                    pairs = list(zip(ends[:-1], ends[1:]))
                    columns = [doc_ids[at : at + 4096], [base + a for a, _ in pairs], [b - a for a, b in pairs], [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairs]]
                    if with_ids:
                        columns.append([ids[a:b].astype(np.int64) for a, b in pairs])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    spread = manifest.select("path", "start").repartition(partitions(manifest.sparkSession, 8), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_tokens(manifest: DataFrame, wanted: DataFrame, position: str = "position") -> DataFrame:
    """(position) -> (position, token): single ids by their place in the corpus.  A file's few bytes
    of each are fetched; positions outside the corpus, and null ones, give no row.

    A position meets its file by equality on the number of its stretch of ``FILE_TOKENS`` places, of
    which a file lies in as many as it reaches into; the stretches of hot files are read as they come."""
    files = manifest.where("tokens > 0").select("path", "start", "tokens")
    first, last = (F.expr(f"({end}) div {FILE_TOKENS}") for end in ("start", "start + tokens - 1"))
    files = files.withColumn("stretch", F.explode(F.sequence(first, last)))
    places = wanted.select(F.col(position).cast("long").alias("position")).where("position >= 0").withColumn("stretch", F.expr(f"position div {FILE_TOKENS}"))
    met = places.join(files, "stretch").where("position >= start and position < start + tokens").select("path", "start", "position")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list[tuple[int, int]]] = {}
            for path, start, place in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows.setdefault(path, []).append((place, place - start))
            found = []
            for path, places in rows.items():
                with opened(path) as source:
                    file = TokenFile(reader(source))
                    found += [(place, file.token(at)) for place, at in places]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["position", "token"])

    return met.mapInArrow(read, "position long, token long")


def store(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    return read_documents(write_tokens(docs, tokenizer, fresh_folder(docs.sparkSession, "tokens"), end_id, id_col))
