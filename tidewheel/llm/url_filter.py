"""URL filter: rules first, then a character language-model ratio.

Rules name a host and a path start; a rule fits its host and all subdomains when the
URL's path starts with the rule's, and the longest fitting rule decides.  URLs that no
rule fits are judged by two smoothed variable-order Markov models of characters, one of
accepted and one of rejected URLs (those that rules decide): Witten-Bell smoothing backs
each order off to the next, and the log-likelihood difference per character is held
against a threshold calibrated by cross-fitting: each labelled URL is scored by models that
leave out its fold, one of five by the URL's hash.

The models that judge count every labelled URL.  Counts are exact and grow with the input: rows
keyed by class and gram, a gram being a character with the ``ORDER`` before it packed into a
long.  The counts of orders 0 and 1 fit 65,536 cells and are broadcast; those of each higher
order are sums of the next one's, joined with their context (at most 256 grams have one in
common) and with the probability of the order below (again at most 256), so no group and no
key grows with the input.  The log ratios are joined to the URLs' characters; those of the
``HOT`` most frequent grams are added up before the join.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and
is allowed, as is every URL when either class has no examples; a fold that holds all examples
of a class is not used for the threshold, which is 0 when a class has none left; every byte is a symbol but
for the case of letters, which is ignored; ties of score and threshold are allowed; repeated
URLs count each and are scored once; URLs of any length are scored whole, a batch of them in
memory; null ids are carried through; further columns of the table (also ones named host,
path, rule or verdict) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._session import cut

ORDER, SYMBOLS = 5, 256
FOLDS, JUDGED = 5, 10  # cells of a gram: 5 folds of rejected, 5 of accepted, then URLs to judge
LEFT_OUT = (*range(FOLDS), None)  # models, by the fold that their counts leave out; the last one judges
HOT = 1 << 15
BINS, REACH = 4096, 16.0  # of the scores' histogram
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    pattern: str  # host, then the path start from its first slash
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def split_url(url: str = "url") -> tuple[Column, Column]:
    """(host, path) Columns."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(F.col(url), shape, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(F.col(url), shape, 2), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(pattern, verdict) Columns of the longest fitting rule, else null."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # later ones win
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern = F.when(fits, F.lit(rule.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pattern, verdict


def _symbols() -> np.ndarray:
    """Byte -> symbol: itself, letters without case; 0 starts a URL, so a zero byte takes a free one."""
    to = np.arange(SYMBOLS)
    to[list(UPPER.encode())] = list(LOWER.encode())
    to[0] = ord("A")
    return to


SYMBOL = _symbols()


def grams(urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, url number) of all characters: the symbol in the lowest byte, the one before it in the next."""
    raw = [u.encode() for u in urls]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    sym = SYMBOL[np.frombuffer(b"".join(raw), np.uint8)]
    seq = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gram = sym.copy()
    for k in range(1, min(ORDER, len(sym)) + 1):
        gram[k:] |= np.where(place[k:] >= k, sym[:-k], 0) << (8 * k)
    return gram, seq


def count(labelled: DataFrame) -> DataFrame:
    """(url, cell) -> (key, n), key = gram * 16 + cell; checkpointed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

        def rows(keys, n):
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pd.DataFrame({"key": part, "n": n[k : k + 100_000]})

        held, waiting = [], 0
        for frame in frames:
            for k in range(0, len(frame), 2000):
                part = frame.iloc[k : k + 2000]
                gram, seq = grams(part["url"].tolist())
                held.append(np.unique(gram * 16 + part["cell"].to_numpy(np.int64)[seq], return_counts=True))
                waiting += len(held[-1][0])
                if waiting > 1_000_000:
                    held = [merged()]
                    waiting = 0
                    if len(held[0][0]) > 1_000_000:
                        yield from rows(*held[0])
                        held = []
        if held:
            yield from rows(*merged())

    return cut(labelled.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))


def _by_model(cells: np.ndarray) -> np.ndarray:
    """Counts (..., cells) -> (..., class, model)."""
    by = cells[..., : 2 * FOLDS].reshape(*cells.shape[:-1], 2, FOLDS)
    return np.stack([by.sum(axis=-1) - (0 if f is None else by[..., f]) for f in LEFT_OUT], axis=-1)


def _smoothed(counts, total, kinds, p):
    return np.where(total > 0, (counts + kinds * p) / np.where(total > 0, total + kinds, 1), p)


def low_orders(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of order 1 (SYMBOLS * SYMBOLS, class, model), characters counted (class, model))."""
    pair = F.expr(f"(key >> 4) & {SYMBOLS * SYMBOLS - 1}")
    found = cells.groupBy(pair.alias("pair"), F.expr("key & 15").alias("cell")).agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((SYMBOLS * SYMBOLS, JUDGED + 1))
    table[found["pair"].to_numpy(int), found["cell"].to_numpy(int)] = found["n"].to_numpy()
    one = _by_model(table).reshape(SYMBOLS, SYMBOLS, 2, len(LEFT_OUT))
    none = one.sum(axis=0)
    p = _smoothed(none, none.sum(axis=0), (none > 0).sum(axis=0), 1.0 / SYMBOLS)
    p = _smoothed(one, one.sum(axis=1, keepdims=True), (one > 0).sum(axis=1, keepdims=True), p)
    return p.reshape(-1, 2, len(LEFT_OUT)), none.sum(axis=0)


def ratios(cells: DataFrame, low: np.ndarray) -> DataFrame:
    """(gram, n, r0, ...): log P(symbol | context) of accepted minus rejected, by model; checkpointed."""
    models = [f"{y}_{m}" for y in range(2) for m in range(len(LEFT_OUT))]
    kept = lambda x: ", ".join(str(int(x[0]) * FOLDS + f) for f in range(FOLDS) if f != LEFT_OUT[int(x[2:])])
    in_cells = [F.expr(f"sum(CASE WHEN (key & 15) IN ({kept(x)}) THEN n ELSE 0 END) AS n{x}") for x in models]
    orders = {ORDER: cut(cells.groupBy(F.shiftright("key", 4).alias("gram")).agg(F.sum("n").alias("times"), *in_cells))}
    for k in range(ORDER - 1, 1, -1):
        short = F.expr(f"gram & {(1 << 8 * (k + 1)) - 1}L AS gram")
        orders[k] = orders[k + 1].groupBy(short).agg(*[F.expr(f"sum(n{x}) AS n{x}") for x in models])
    rows = [(k, *q) for k, q in enumerate(low.reshape(SYMBOLS * SYMBOLS, len(models)).tolist())]
    shape = "below long, " + ", ".join(f"q{x} double" for x in models)
    below = F.broadcast(cells.sparkSession.createDataFrame(rows, shape, verifySchema=False))  # 65,536 rows
    totals = [F.expr(f"sum(n{x}) AS t{x}") for x in models] + [F.expr(f"count(CASE WHEN n{x} > 0 THEN 1 END) AS k{x}") for x in models]
    smoothed = [f"CASE WHEN t{x} > 0 THEN (n{x} + k{x} * q{x}) / (t{x} + k{x}) ELSE q{x} END AS q{x}" for x in models]
    for k in range(2, ORDER + 1):
        grams_ = orders[k].selectExpr("*", "shiftright(gram, 8) AS context", f"gram & {(1 << 8 * k) - 1}L AS below")
        joined = grams_.join(grams_.groupBy("context").agg(*totals), "context").join(below, "below")
        p = joined.selectExpr("gram", *(["times"] if k == ORDER else []), *smoothed)
        below = p.withColumnRenamed("gram", "below")
    return cut(p.selectExpr("gram", "times AS n", *[f"ln(q1_{m}) - ln(q0_{m}) AS r{m}" for m in range(len(LEFT_OUT))]))


def scores(urls: DataFrame, ratio: DataFrame, hot) -> DataFrame:
    """Distinct (url_key, url, model) -> (url_key, score): log P(url | accepted) - log P(url | rejected), per character."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, values = hot.value
        for frame in frames:
            for k in range(0, len(frame), 2000):
                part = frame.iloc[k : k + 2000]
                gram, seq = grams(part["url"].tolist())
                key, model = part["url_key"].to_numpy(object), part["model"].to_numpy(np.int64)
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                held = known[at] == gram
                sums = np.bincount(seq[held], weights=values[at[held], model[seq[held]]], minlength=len(part))
                # a URL's own row has a negative number for a gram, so these rows spread over the join
                yield pd.DataFrame({"url_key": key, "model": model, "gram": -1 - np.arange(len(part)), "times": 0, "held": sums, "n": np.bincount(seq, minlength=len(part))})
                rest = pd.DataFrame({"seq": seq[~held], "gram": gram[~held]}).value_counts(sort=False).rename("times").reset_index()
                yield pd.DataFrame({"url_key": key[rest["seq"]], "model": model[rest["seq"]], "gram": rest["gram"], "times": rest["times"], "held": 0.0, "n": 0})

    spelt = urls.select("url_key", "url", "model").mapInPandas(run, "url_key binary, model int, gram long, times long, held double, n long")
    value = F.col("held") + F.col("times") * F.coalesce(F.array(*[f"r{m}" for m in range(len(LEFT_OUT))])[F.col("model")], F.lit(0.0))
    joined = spelt.join(ratio.drop("n"), "gram", "left").groupBy("url_key").agg(F.sum(value).alias("v"), F.sum("n").alias("n"))
    # rounded, as the order of a sum varies
    return joined.select("url_key", F.round(F.col("v") / F.greatest("n", F.lit(1)), 12).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """(score, good, n rows) -> the threshold with the best balanced accuracy, from a histogram of
    all labelled scores; of equally good thresholds the middle one."""
    bin_ = F.floor((F.greatest(F.lit(-REACH), F.least(F.lit(REACH - 1e-9), "score")) + REACH) / (2 * REACH) * BINS).cast("int")
    rows = scored.groupBy(bin_.alias("bin"), "good").agg(F.sum("n").alias("count")).collect()
    n = np.zeros((2, BINS))
    for r in rows:
        n[int(r["good"]), r["bin"]] = r["count"]
    if not n.sum(axis=1).all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(n, axis=1)), axis=1) / n.sum(axis=1, keepdims=True)
    quality = below[0] + 1.0 - below[1]
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return float(best.mean() / BINS * 2 * REACH - REACH)


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = split_url()
    pattern, by_rule = longest_rule(rules, F.col("host"), F.col("path"))
    base = pages.select(F.col(id_col), "url").withColumn("host", host).withColumn("path", path)
    base = base.withColumn("rule", pattern).withColumn("by_rule", by_rule).withColumn("url_key", F.unhex(F.md5("url")))
    fold, good = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"), F.col("by_rule") == "allow"
    labelled = base.where("rule is not null").select("url_key", "url", good.alias("good"), fold.alias("fold"))
    open_ = F.col("rule").isNull() & (F.col("host") != "")
    cell = F.when(open_, F.lit(JUDGED)).otherwise(F.when(good, F.lit(FOLDS)).otherwise(F.lit(0)) + fold)
    cells = count(base.where(open_ | F.col("rule").isNotNull()).select("url", cell.alias("cell")))
    low, counted = low_orders(cells)
    settled = base.select(id_col, "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    if not counted[:, -1].all():
        return settled
    ratio = ratios(cells, low)
    top = ratio.orderBy(F.desc("n"), "gram").limit(HOT).toPandas().sort_values("gram")
    hot = pages.sparkSession.sparkContext.broadcast((top["gram"].to_numpy(), top[[f"r{m}" for m in range(len(LEFT_OUT))]].to_numpy()))
    fair = [f for f in range(FOLDS) if counted[:, f].all()]  # the others' models lack a class
    examples = labelled.where(F.col("fold").isin(fair)).groupBy("url_key", "good", F.col("fold").alias("model")).agg(F.first("url").alias("url"), F.count("*").alias("n"))
    threshold = calibrate(examples.select("url_key", "good", "n").join(scores(examples, ratio, hot), "url_key"))
    asked = base.where(open_).groupBy("url_key").agg(F.first("url").alias("url")).withColumn("model", F.lit(FOLDS))
    judged = base.where(open_).join(scores(asked, ratio, hot), "url_key", "left")
    verdict = F.when(F.col("score") < threshold, "block").otherwise("allow")
    judged = judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
    return settled.where(~open_).union(judged)
