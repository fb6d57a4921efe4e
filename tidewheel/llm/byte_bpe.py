"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decode.

Encoding.  A token sequence is the BPE encoding of its bytes exactly when every
neighbouring pair of it is the encoding of that pair's bytes, and each prefix of a text
has exactly one encoding.  So the merges compile into a nondeterministic transducer: a
hypothesis is (last whole token, trie node of the token being read), and a token may end
only where it is compatible with the one before.  Determinising it on the fly gives
states that are sets of hypotheses, each with the tokens it has read but not emitted;
what all hypotheses agree on is emitted, so output trails input by a bounded lookahead
(the longest token).  States and transitions are interned as texts need them, and
pre-token results are remembered, in two generations; states are cleared when full.

Decoding.  Ids become text through an incremental UTF-8 automaton whose state survives
from token to token, so characters split between tokens come out whole; ill-formed input
gives one U+FFFD per maximal ill-formed part.

Defined cases: null text encodes as empty; a pre-token of any length is read in one
stream; no special tokens exist; ids outside the vocabulary raise; repeated rows and null
ids keep a row each; further columns of the table are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = 0
#: Interned states and transitions a worker keeps; pre-tokens of a generation it remembers (it
#: keeps two), and the longest pre-token remembered.
STATES, MOVES, MEMO, MEMO_CHARS = 250_000, 500_000, 300_000, 64
#: Rows whose results leave a worker together.
ROWS = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_small(data: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Plain merging of a token's bytes, until ``stop`` parts are left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > stop:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.ranks, self.share = ranks, share  # of the stores' sizes
        self.token = {i: b for b, i in ranks.items()}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        # trie: child by node * 256 + byte; token that ends at a node; nodes that go on
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: set[int] = set()
        for data, i in ranks.items():
            node = ROOT
            for b in data:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.add(node)
                node = self.child[key]
            self.ends[node] = i
        self._edges()
        self.fits: dict[int, bool] = {}
        self._clear()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.hypotheses: list[tuple] = []
        self.move: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self.start = self._state(((-1, ROOT, ()),))

    def _state(self, hypotheses: tuple) -> int:
        at = self.number.get(hypotheses)
        if at is None:
            at = self.number[hypotheses] = len(self.hypotheses)
            self.hypotheses.append(hypotheses)
        return at

    def _edges(self) -> None:
        """The two tokens that each token's last merge joins (-1: it is one byte).  Tokens that
        merging never makes of their own bytes get none."""
        self.parts: dict[int, tuple[int, int]] = {}
        for data, i in sorted(self.ranks.items(), key=lambda x: len(x[0])):
            parts = [data[:1]] if len(data) == 1 else merge_small(data, self.ranks, stop=2)
            if len(data) == 1:
                self.parts[i] = -1, -1
            elif len(parts) == 2 and b"".join(parts) == data:
                a, b = (self.ranks[x] for x in parts)
                if a in self.parts and b in self.parts:
                    self.parts[i] = a, b

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's left (0) or right (1) edge while it forms: pairs of (token,
        rank of the merge that takes it up), latest first."""
        out, until = [], 1 << 40
        while token >= 0:
            out.append((token, until))
            token, until = self.parts[token][side], token
        return out

    def compatible(self, before: int, token: int) -> bool:
        """Whether ``before token`` is the encoding of its own bytes (-1: nothing before).

        The two form independently unless at some moment what stands on either side of
        the boundary could merge before either side's next merge; of equal ranks the
        leftmost goes first."""
        if token not in self.parts or before < 0:
            return token in self.parts
        key = before << 32 | token
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MOVES * self.share:
                self.fits.clear()
            known = True
            left = self._edge(token, 0)
            for a, until in self._edge(before, 1):
                for b, to in left:
                    made = self.ranks.get(self.token[a] + self.token[b])
                    if made is not None and made < until and made <= to:
                        known = False
            self.fits[key] = known
        return known

    def _step(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """Determinise one transition: the next state, with the tokens emitted if there are any."""
        after, child_of, ends, inner, fits = [], self.child, self.ends, self.inner, self.fits
        for before, node, pending in self.hypotheses[state]:
            child = child_of.get(node << 8 | byte)
            if child is None:
                continue
            token = ends[child]
            if token >= 0:
                fit = fits.get(before << 32 | token)
                if self.compatible(before, token) if fit is None else fit:
                    after.append((token, ROOT, (*pending, token)))
            if child in inner:
                after.append((before, child, pending))
        first = after[0][2]
        common = len(first)
        for _, _, pending in after[1:]:
            common = min(common, len(pending))
            k = 0
            while k < common and pending[k] == first[k]:
                k += 1
            common = k
            if not common:
                break
        if common:
            found = self._state(tuple([(b, n, p[common:]) for b, n, p in after])), first[:common]
        else:
            found = self._state(tuple(after))
        self.move[state << 8 | byte] = found
        return found

    def tokens(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        if len(self.hypotheses) > STATES * self.share or len(self.move) > MOVES * self.share:
            self._clear()
        out: list[int] = []
        state, move = self.start, self.move
        for byte in data:
            step = move.get(state << 8 | byte)
            if step is None:
                if len(move) > 4 * MOVES * self.share:  # one endless pre-token: start the stores afresh
                    held = self.hypotheses[state]
                    self._clear()
                    state, move = self._state(held), self.move
                step = self._step(state, byte)
            if type(step) is int:
                state = step
            else:
                state = step[0]
                out += step[1]
        for _, node, pending in self.hypotheses[state]:
            if node == ROOT:
                out += pending
                break
        return out

    def encode(self, words: Iterable[str]) -> bytes:
        """Little-endian unsigned 32-bit ids of a text's pre-tokens."""
        if len(self.memo) > MEMO * self.share:
            self.old, self.memo = self.memo, {}
        memo, old, out = self.memo, self.old, []
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    ids = np.array(self.tokens(w.encode()), "<u4").tobytes()
                if len(w) <= MEMO_CHARS:
                    memo[w] = ids
            out.append(ids)
        return b"".join(out)


#: Well-formed UTF-8 by lead byte (first, last, range of the second byte, bytes that follow it).
UTF8 = (
    (0xC2, 0xDF, 0x80, 0xBF, 0),
    (0xE0, 0xE0, 0xA0, 0xBF, 1),
    (0xE1, 0xEC, 0x80, 0xBF, 1),
    (0xED, 0xED, 0x80, 0x9F, 1),
    (0xEE, 0xEF, 0x80, 0xBF, 1),
    (0xF0, 0xF0, 0x90, 0xBF, 2),
    (0xF1, 0xF3, 0x80, 0xBF, 2),
    (0xF4, 0xF4, 0x80, 0x8F, 2),
)


class Utf8Stream:
    """Incremental UTF-8: feed bytes in any pieces, get whole characters."""

    def __init__(self) -> None:
        self.lead = {b: (lo, hi, more) for first, last, lo, hi, more in UTF8 for b in range(first, last + 1)}
        self.held = bytearray()
        self.low, self.high, self.more = 0, 0, -1  # more: bytes after the expected one; -1: between characters

    @property
    def between(self) -> bool:
        return self.more < 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.more >= 0:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.low, self.high, self.more = 0x80, 0xBF, self.more - 1
                    if self.more < 0:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.more = -1
            if b < 0x80:
                out.append(chr(b))
            elif b in self.lead:
                self.held.append(b)
                self.low, self.high, self.more = self.lead[b]
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        cut = "" if self.between else "�"
        self.held.clear()
        self.more = -1
        return cut


class Decoder:
    """Ids to text.  Tokens that are whole characters pass at once while the automaton is
    between characters; others run through it byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of: dict[int, str | None] = {}
        for i, b in self.bytes_of.items():
            probe = Utf8Stream()
            text = probe.feed(b)
            self.text_of[i] = text if probe.between and text.encode() == b else None

    def decode(self, ids: Iterable[int], chunk: int = 65536) -> str:
        ids = list(ids)
        stream, out = Utf8Stream(), []
        for at in range(0, len(ids), chunk):
            part = ids[at : at + chunk]
            texts = [self.text_of[i] for i in part]
            if stream.between and None not in texts:
                out += texts
                continue
            for i, text in zip(part, texts):
                out.append(text if text is not None and stream.between else stream.feed(self.bytes_of[i]))
        out.append(stream.end())
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, share: float = 1.0):
    import regex

    ranks = read_ranks(path)
    return Transducer(ranks, share), Decoder(ranks), regex.compile(pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids (array<long>) of every whole text."""

    @F.pandas_udf("array<long>")
    def ids(texts: pd.Series) -> pd.Series:
        encoder, _, split = codec(path, pattern)
        return pd.Series([np.frombuffer(encoder.encode(split.findall(t or "")), "<u4").astype(np.int64) for t in texts])

    return docs.select(F.col(id_col), ids("text").alias("ids"))


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, text of every row of ids (null: empty)."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        _, decoder, _ = codec(path, pattern)
        return pd.Series([decoder.decode([] if r is None else r) for r in rows])

    return encoded.select(F.col(id_col), text("ids").alias("text"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", keep_ids: bool = False, share: float = 1.0) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 in one pass: encode, then decode the ids.
    Texts are read and results leave a few hundred at a time, so a worker holds little;
    ``share`` makes its stores smaller, for time.
    ``keep_ids`` adds ids (binary: little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, split = codec(path, pattern, share)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, found = batch.slice(at, ROWS), ([], [], [], [])
                for text in part.column(1):
                    ids = encoder.encode(split.findall(text.as_py() or ""))
                    back = decoder.decode(np.frombuffer(ids, "<u4").tolist())
                    for column, value in zip(found, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids if keep_ids else None)):
                        column.append(value)
                arrays = [pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.string()), pa.array(found[3], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays[: 3 + keep_ids]], names=names)

    rows = docs.select(F.col(id_col), "text")
    shape = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.BinaryType())][: 4 + keep_ids])
    names = shape.names
    return rows.mapInArrow(run, shape)
