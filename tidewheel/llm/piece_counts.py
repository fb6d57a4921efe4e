"""Token counts of a piece-merging vocabulary by rank-synchronous array merging.

Text is normalised by the vocabulary's own rules and cut into pre-tokens where no piece
can reach across (before a run of word marks).  A batch of pre-tokens is one flat array
of symbol ids with a sequence number beside it.  Each round every sequence finds its
best-scored adjacent pair and merges it, all sequences at once; what survives is counted.
A merge is made at every non-overlapping place of its sequence in the same round, except
for pieces whose making could open a better-scored merge: those go leftmost first, one a
round, as a queue ordered by score and place would.

Defined cases: null text counts as empty; symbols outside the vocabulary count as their
UTF-8 bytes (byte fallback) or one unknown each; strings that look like special pieces
are ordinary text.  A pre-token of any length is one sequence: nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Distinct pre-tokens whose counts a worker remembers, and the longest it remembers.
MEMO, MEMO_CHARS = 1_200_000, 48
#: Bits of the pair table, and the mark of a slot that several pairs share.
SLOT_BITS, SHARED = 20, -2
#: Symbols merged in one batch; characters of text whose pre-tokens are held at a time.
BATCH, GROUP = 400_000, 4_000_000


class PieceCounter:
    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp, n = self.sp, self.sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        pieces = [sp.id_to_piece(i) for i in normal]
        score = [sp.get_score(i) for i in normal]
        known = {p: k for k, p in enumerate(pieces)}
        if any(c != MARK and d == MARK for p in pieces for c, d in zip(p, p[1:])):
            raise ValueError("a piece reaches over a word mark: pre-tokens would not be independent")
        # rank: smaller merges first; equal scores share a rank and go leftmost first
        order = {s: r for r, s in enumerate(sorted(set(score), reverse=True))}
        rank = [order[s] for s in score]
        bytes_known = any(sp.is_byte(i) for i in range(n))
        self.fallback = bytes_known
        # characters that only occur inside longer pieces still take part in merges
        symbols = list(pieces)
        for c in sorted({c for p in pieces for c in p} - known.keys()):
            symbols.append(c)
        self.symbol = {s: k for k, s in enumerate(symbols)}
        cost = np.ones(len(symbols) + 1, np.int64)
        for k in range(len(pieces), len(symbols)):
            cost[k] = len(symbols[k].encode()) if bytes_known else 1
        self.cost, self.stranger = cost, len(symbols)
        # (left, right) -> merged, as one sorted array of keys
        base = len(symbols) + 1
        keys, to = [], []
        worse_part = np.zeros(base, bool)
        for k, p in enumerate(pieces):
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * base + right)
                    to.append(k)
                    for part in (left, right):
                        if part < len(pieces) and len(symbols[part]) > 1 and rank[part] > rank[k]:
                            worse_part[part] = True
        by = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.to = np.array(keys, np.int64)[by], np.array(to, np.int64)[by]
        place = self._place(self.keys)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot[place] = np.arange(len(self.keys), dtype=np.int32)
        self.slot[np.bincount(place, minlength=len(self.slot)) > 1] = SHARED
        self.rank, self.base, self.one_by_one = np.array(rank + [0] * (base - len(pieces)), np.int64), base, worse_part
        self.memo: dict[str, int] = {}
        code = np.full(0x110000, self.stranger, np.int64)
        for s, k in self.symbol.items():
            if len(s) == 1:
                code[ord(s)] = k
        self.code = code

    def pretokens(self, text: str) -> list[str]:
        """Runs of word marks each with the characters up to the next run."""
        norm = self.sp.normalize(text)
        if f"{MARK}{MARK}" in norm:
            import regex

            return regex.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", norm)
        head, *rest = norm.split(MARK)
        return ([head] if head else []) + [MARK + w for w in rest]

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair makes, or -1: a hash table, with binary search for shared slots."""
        key = left * self.base + right
        at = self.slot[self._place(key)]
        out = np.where((at >= 0) & (self.keys[at] == key), self.to[at], -1)
        shared = np.flatnonzero(at == SHARED)
        if len(shared):
            k = key[shared]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[shared] = np.where(self.keys[at] == k, self.to[at], -1)
        return out

    def merge(self, words: list[str]) -> np.ndarray:
        """Token counts of a batch of pre-tokens."""
        counts = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym, seq = self.code[points], np.repeat(np.arange(len(words)), lengths)
        strange = sym == self.stranger
        if strange.any():
            p = points[strange]
            width = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF) if self.fallback else np.ones(len(p), np.int64)
            np.add.at(counts, seq[strange], width)
        # what each symbol and the next one make; -1: nothing, or another sequence begins
        merged = np.append(self.pairs(sym[:-1], sym[1:]), -1) if len(sym) else sym
        merged[:-1][seq[:-1] != seq[1:]] = -1
        while len(sym):
            places = np.flatnonzero(merged >= 0)
            if not len(places):
                break
            made, owner = merged[places], seq[places]
            best = np.full(len(words), np.iinfo(np.int64).max)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best[owner[first]] = np.minimum.reduceat(self.rank[made], first)
            chosen = self.rank[made] == best[owner]
            places, made, owner = places[chosen], made[chosen], owner[chosen]
            places, made = self._apart(places, made, owner)
            # sequences without a mergeable pair are done: count and drop them
            sym[places] = made
            stay = np.ones(len(sym), bool)
            stay[places + 1] = False
            going = best[seq] != np.iinfo(np.int64).max
            ended = stay & ~going
            if ended.any():
                self._count(counts, sym[ended], seq[ended])
            stay &= going
            fresh = np.zeros(len(sym), bool)
            fresh[places] = True
            sym, seq, merged, fresh = sym[stay], seq[stay], merged[stay], fresh[stay]
            fresh[:-1] |= fresh[1:]
            again = np.flatnonzero(fresh[:-1])
            within = seq[again] == seq[again + 1]
            merged[again] = np.where(within, self.pairs(sym[again], sym[again + 1]), -1)
            merged[-1:] = -1
        self._count(counts, sym, seq)
        return counts

    def _apart(self, places: np.ndarray, made: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen places, leftmost first, those that do not overlap; one only where
        what is made could merge on before its rank, or where equal ranks make different pieces."""
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
        # within a run of touching places every second one is taken
        starts = first | np.concatenate(([True], places[1:] != places[:-1] + 1))
        run = np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
        take = (np.arange(len(places)) - run) % 2 == 0
        solo = self.one_by_one[made] | (made != made[lead])
        hit = np.zeros(int(owner[-1]) + 1 if len(owner) else 0, bool)
        hit[owner[solo]] = True
        take &= ~hit[owner] | first
        return places[take], made[take]

    def _count(self, counts: np.ndarray, sym: np.ndarray, seq: np.ndarray) -> None:
        known = sym != self.stranger
        counts += np.bincount(seq[known], weights=self.cost[sym[known]], minlength=len(counts)).astype(np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Token counts of whole texts, whose unknown pre-tokens are merged together."""
        out, at = np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            held, size, to = [], 0, at
            while to < len(texts) and (to == at or size < GROUP):
                held.append(self.pretokens(texts[to]) if texts[to] else [])
                size += len(texts[to] or "")
                to += 1
            fresh = set().union(*held) - self.memo.keys()
            if len(self.memo) + len(fresh) > MEMO:
                self.memo.clear()
                fresh = set().union(*held)
            memo, long_ = self.memo, []
            for part in _chunks(fresh):
                memo.update(zip(part, self.merge(part).tolist()))
                long_ += [w for w in part if len(w) > MEMO_CHARS]
            out[at:to] = [sum(map(memo.__getitem__, words)) for words in held]
            for w in long_:
                del memo[w]
            at = to
        return out


def _chunks(words: Iterable[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w)
        if size >= BATCH:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every whole text.  ``model_path`` must be
    readable on every executor."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(model_path).count(texts.tolist()))

    n = tokens("text")
    return docs.select(F.col(id_col), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
