"""Language identification by compression.

Each language is a Zstandard raw-content dictionary of its labelled text.  A text is
reduced to lower-case letters with single blanks between, cut into blocks, every block is
compressed alone with each language's dictionary, and the language whose blocks sum to the
fewest bytes wins.  The bytes saved against the runner-up, relative to its size, are the
margin.

A margin below ``MIN_MARGIN`` is narrow, at any length; whole bytes then say little.  Such a
text is weighed again: its blocks are compressed behind ``PASSAGES`` passages of each
dictionary's content, so that its letters are coded with the language's statistics, and the
bytes they add are averaged.  It is rejected unless the saving against the runner-up is at
least ``MIN_SIGNAL`` standard errors of these weighings, so the noise that decides is measured
on the text itself.

Fitting reads whole texts of a bounded sample of labelled rows: about ``SAMPLE_ROWS`` distinct
texts a language, chosen by hash of the text at the rate that gives that many, and never more than
the language's share of ``SAMPLE_BYTES``, so very long texts or very many languages fill neither the
driver nor a worker.  Predictions read whole texts of any length and nothing else.

Defined cases: null text or text with no letter is ``und`` with score 0 and is rejected; ties
go to the language first in code-point order and are rejected; with no labelled rows at all
every text is ``und``; a language with little text has a shorter dictionary; a single learned
language takes every text with letters; repeated rows are each judged alike.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 256
#: Bytes of all samples together, dealt evenly over the languages: what driver and workers hold.
SAMPLE_BYTES = 32 << 20
BLOCK, LEVEL = 4096, 6
UNDETERMINED = "und"
#: Margins below this share of the runner-up's size are narrow; standard errors a narrow text must win by.
MIN_MARGIN, MIN_SIGNAL = 0.01, 2.0
#: Weighings of a narrow text at least, and bytes of the passages they stand behind.
PASSAGES, PASSAGE_BYTES = 16, 4000


@lru_cache(maxsize=1)
def _not_letters():
    import regex

    return regex.compile(r"[^\p{L}\p{M}]+")


def reduce_text(text: str) -> str:
    return _not_letters().sub(" ", text).lower()


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id") -> tuple[tuple[str, bytes], ...]:
    """(language, dictionary content) pairs of about SAMPLE_ROWS whole texts each, within the language's
    share of SAMPLE_BYTES: texts are taken in order of their digests as long as they fit, and
    where none fits the shortest is.  The rate is per language, so a map task sends its share of
    the sample whatever their number; repeats of a text are one, and combine before they move."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    whole, spark = 1 << 40, labelled.sparkSession
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row per language
    if not kinds:
        return ()
    shares = [(r["lang"], min(whole, whole * SAMPLE_ROWS // max(1, r["n"]))) for r in kinds]
    share = spark.createDataFrame(shares, "lang string, share long")
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(whole)) < F.col("share")).where("text rlike '\\\\p{L}'")
    drawn: dict[str, list] = {}
    for r in picked.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("n")).collect():  # about SAMPLE_ROWS a language
        drawn.setdefault(r["lang"], []).append((r["h"], r["n"]))
    chosen = []
    for lang, texts in drawn.items():
        left, took = SAMPLE_BYTES // len(drawn), []
        for h, n in sorted(texts):
            if n <= left:
                took.append((lang, h))
                left -= n
        chosen += took or [(lang, min(texts, key=lambda t: (t[1], t[0]))[0])]
    wanted = F.broadcast(spark.createDataFrame(chosen, "lang string, h long"))
    found = rows.join(wanted, ["lang", "h"]).groupBy("lang", "h").agg(F.any_value("text").alias("text")).collect()
    content: dict[str, list] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["h"])):
        content.setdefault(row["lang"], []).append(reduce_text(row["text"]))
    return tuple((lang, " ".join(parts).encode()) for lang, parts in sorted(content.items()))


class Classifier:
    def __init__(self, model: tuple[tuple[str, bytes], ...], level: int = LEVEL):
        import regex
        import zstandard

        self.names = [name for name, _ in model]
        self.coders, self.passages = [], []
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        for _, content in model:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False))
            starts = [k * len(content) // PASSAGES for k in range(PASSAGES)]
            parts = [content[at : at + PASSAGE_BYTES] + b" " for at in starts]
            self.passages.append([(part, len(self.plain.compress(part))) for part in parts])
        self.letter = regex.compile(r"\p{L}")

    def sizes(self, blocks: list[bytes]) -> list[int]:
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def weighings(self, blocks: list[bytes]) -> np.ndarray:
        """Bytes that a block adds behind a passage: (languages, weighings), at least PASSAGES
        of them, dealt over the blocks."""
        each = -(-PASSAGES // len(blocks))
        pairs = [(b, (k * each + c) % PASSAGES) for k, b in enumerate(blocks) for c in range(each)]
        return np.array([[len(self.plain.compress(parts[c][0] + b)) - parts[c][1] for b, c in pairs] for parts in self.passages], float)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        if text is None or not self.names or not self.letter.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        data = reduce_text(text).encode()
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = np.array(self.sizes(blocks), float)
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0, False
        best, margin = _winner(sizes)
        rejected = False
        if margin < MIN_MARGIN:
            weighed = self.weighings(blocks)
            sizes = weighed.mean(axis=1)
            best, margin = _winner(sizes)
            saved = weighed[np.argsort(sizes, kind="stable")[1]] - weighed[best]
            rejected = bool(saved.mean() <= 0 or saved.mean() < MIN_SIGNAL * saved.std(ddof=1) / math.sqrt(len(saved)))
        # code lengths as probabilities: a byte saved is eight bits of evidence
        score = 1.0 / float(np.exp2(-np.minimum(8.0 * (sizes - sizes[best]), 1000.0)).sum())
        return self.names[best], score, margin, rejected


def _winner(sizes: np.ndarray) -> tuple[int, float]:
    """(the smallest, the saving against the next relative to it)."""
    best, after = np.argsort(sizes, kind="stable")[:2]
    return int(best), float((sizes[after] - sizes[best]) / max(sizes[after], 1.0))


@lru_cache(maxsize=2)
def _classifier(model: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(model)


def identify(docs: DataFrame, model: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """Input columns plus lang_pred, score, margin, rejected (columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        of = _classifier(shared.value)
        return pd.DataFrame([of.predict(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    names = ("lang_pred", "score", "margin", "rejected", "__tw_pred")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.drop(*names).withColumn("__tw_pred", predict("text")).select(*kept, "__tw_pred.*")


def keep_identified(docs: DataFrame, model: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """The documents whose language is not rejected, with all their columns and no others."""
    rows = docs.select(F.struct("*").alias("__tw_row"), "text")
    return identify(rows, model).where("not rejected").select("__tw_row.*")
