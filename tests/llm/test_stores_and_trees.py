"""Token files, clustering by centroids and the Merkle manifest: against the library, brute force and
their documented edge cases."""

import hashlib
import io
import random
import zlib
from math import floor
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import centroids, merkle, queries, token_store

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, n_tokens string, key string"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "y", "z") for r in rows], DOCS)


def awkward(spark):
    long_ = " ".join(f"word{i % 997}" for i in range(30_000))
    return documents(spark, [
        (1, None, None, None), (2, "", "en", "a"), (3, "The Same text", "en", "a"), (3, "The Same text", "en", "a"), (3, "another", "en", "a"),
        (None, "NO id here", None, "b"), (None, None, None, "b"), (4, long_, "de", ""), (5, " \t\n", "en", None), (6, "x" * 5000, "en", "é"), (7, "<|endoftext|> \x85<|endoftext|>", "en", "c"),
    ])


# 11


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_encoder_equals_library(library, monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 500)
    monkeypatch.setattr(token_store, "MEMO_CHARS", 4)
    rng = random.Random(1)
    parts = [*" \n\t  ab'slréß1²!?.,<|>\x1c\x1f\x85\xa0​ 　中文😀́ſƀ", "<|endoftext|>", "'re", " the", "  ", "\r\n", " word.", " Wort,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["", " ", "a" * 3000, "x y " * 900]
    encoder, found = token_store.TextEncoder(BYTE_BPE), []
    assert encoder.by_runs
    for at in range(0, len(texts), 100):
        found += [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts[at : at + 100])]
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.memo) <= 500


def test_encoder_gives_other_tokenizers_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, texts = token_store.TextEncoder(path), ["Hello,  World's end", "", None]
    assert not encoder.by_runs
    wanted = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == wanted


def test_equal_pieces_are_encoded_once(monkeypatch):
    """Whatever stands around spaces, ids are the library's; words that texts share are neither cut nor
    looked up one by one, and the store of pieces stays bounded."""
    monkeypatch.setattr(token_store, "PIECES", 300)
    cut = []
    monkeypatch.setattr(token_store, "RUNS", SimpleNamespace(findall=lambda text, find=token_store.RUNS.findall: cut.append(len(text)) or find(text)))
    encoder, rng = token_store.TextEncoder(BYTE_BPE), random.Random(8)
    words = ["".join(rng.choices("abcdeé,.!", k=rng.randrange(1, 9))) for _ in range(500)]
    for _ in range(3):
        texts = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
        assert encoder.encode(texts) == encoder.whole(texts)
        assert len(encoder.pieces) <= 300 and len(encoder.ids) == encoder.ends[-1] and len(encoder.last) == len(encoder.pieces) == len(encoder.ends) - 1
    assert sum(cut) < 3 * 60 * 20  # first pieces alone
    odd = [" ", "  ", "   ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\x85", "\x1c", "\0", "a", "The", ".", "!!", "'s", "1", "é", "中文", "👍", "\u0301", "x" * 70, "<|endof"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(14))) for _ in range(20_000)] + ["", None, "  ", "a ", " \n a", "x" * 5000, " " * 5000]
    assert [i for k in range(0, len(texts), 999) for i in encoder.encode(texts[k : k + 999])] == encoder.whole([t or "" for t in texts])


def test_slices_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(token_store, "ROWS", 4)
    monkeypatch.setattr(token_store, "ROWS_BYTES", 10)
    texts = ["é" * 5, "a", None, "", "", "", "b" * 30, "c" * 9, "d", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    assert [part.column(0).to_pylist() for part in token_store.slices(batch)] == [[0], [1, 2, 3, 4], [5], [6], [7, 8], [9]]
    assert not list(token_store.slices(batch.slice(0, 0)))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 3000])
@pytest.mark.parametrize("bits", [1, 8, 17, 31])
def test_codes_give_back_every_token(n, bits):
    rng = random.Random(n)
    ids = np.array([int(2 ** rng.uniform(0, bits)) - 1 for _ in range(n)], np.uint32)
    out = io.BytesIO()
    token_store.write_file(out, [5, None], [n, 0], ids)
    file = token_store.TokenFile(token_store.reader(out))
    assert (file.every() == ids).all() and file.doc_ids() == [5, None] and file.starts().tolist() == [0, n, n]
    assert all(file.token(k) == ids[k] for k in range(min(n, 1200)))
    with pytest.raises(IndexError):
        file.token(n)


def test_one_token_reads_few_bytes():
    ids = np.arange(50_000, dtype=np.uint32)
    out = io.BytesIO()
    token_store.write_file(out, [1], [len(ids)], ids)
    seen, read = [], token_store.reader(out)
    file = token_store.TokenFile(lambda at, size: seen.append(size) or read(at, size))
    seen.clear()
    assert file.token(49_999) == 49_999 and sum(seen) < 80 * len(file.levels)


def test_widths_are_the_smallest():
    lengths = np.bincount([1] * 500 + [4] * 300 + [9] * 40 + [12] * 3)

    def bits(widths):
        low, total = 0, 0.0
        for k, w in enumerate(widths):
            n = lengths[low + 1 :].sum() if low else lengths.sum()
            total += n * w + (n * (1 + 64 / token_store.STRIDE) if k + 1 < len(widths) else 0)
            low += w
        return total

    ways = [[b - a for a, b in zip((0, *c), (*c, 12))] for m in range(1 << 11) for c in [[k + 1 for k in range(11) if m >> k & 1]]]
    assert bits(token_store.best_widths(lengths)) == pytest.approx(min(map(bits, ways)))


def brute_store(library, rows, end):
    """Per row in the order of the corpus: id, start, tokens, crc of the ids."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store_of_documents(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_TOKENS", 3000)  # several files a range
    found = sorted(tuple(r) for r in queries.op11_token_store(spark, SF).collect())
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert found == brute_store(library, rows, 2)


def test_token_store_edges_and_access(spark, library, tmp_path):
    docs = awkward(spark)
    manifest = token_store.write_tokens(docs, BYTE_BPE, f"file://{tmp_path}/ids", end_id=2).cache()
    rows = token_store.read_documents(manifest, with_ids=True).orderBy("start").collect()
    digest = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0] is None, r[0] or 0, digest[r]))
    assert [tuple(r)[:4] for r in rows] == brute_store(library, order, 2)
    ids = [i for r in rows for i in r.ids]
    places = [0, 1, len(ids) - 1, len(ids) // 2, 3, 3]
    wanted = spark.createDataFrame([(p,) for p in [*places, -1, len(ids), None]], "position long")
    found = sorted(tuple(r) for r in token_store.read_tokens(manifest, wanted).collect())
    assert found == sorted((p, ids[p]) for p in places)
    assert token_store.store(docs.limit(0), BYTE_BPE, 2).count() == 0


# 12


def brute_clusters(rows, k=8, rounds=10, dim=64):
    kept = [(i, [floor(float(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds if kept else 0):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in placed if c == j) for j in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for i, d, c in placed), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<float>, cluster string")


def test_centroids_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) + (i % 5)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[7][1]), (900, [0.0] * 64), (901, [-0.0005] * 64)]  # repeats, a null id, ties
    rows += [(902, None), (903, [1.0] * 63), (904, []), (905, [None, *[1.0] * 63]), (906, [float("nan")] * 64), (907, [float("inf"), *[0.0] * 63])]
    assert sorted((tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()), key=str) == brute_clusters(rows)


def test_centroids_of_few_or_no_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [2.0] * 64), (2, [2.0] * 64)]
    assert sorted((tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()), key=str) == brute_clusters(rows)
    assert centroids.cluster(vectors(spark, rows).limit(0)).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)])).collect() == []
    with pytest.raises(ValueError, match="components reach"):
        centroids.cluster(vectors(spark, [(1, [1e6] * 64)]))


def test_assign_keeps_columns(spark):
    held = vectors(spark, [(1, [1.0] * 4), (2, [5.0] * 4)]).withColumn("note", F.lit("n"))
    out = centroids.assign(held, [[0] * 4, [5 * 1024] * 4]).orderBy("vec_id").collect()
    assert [(r.vec_id, r.note, r.cluster, r.distance) for r in out] == [(1, "n", 0, 4 << 20), (2, "n", 1, 0)]


# 13


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, every=5):
    """Rows of the audit from whole trees held in lists."""
    leaf = lambda r, text: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][at : at + 16])) for at in range(0, len(out[-1]), 16)])
        return out

    def path(tree, at):
        out = []
        for nodes in tree[:-1]:
            begin = at // 16 * 16
            out.append(("".join(nodes[begin:at]), "".join(nodes[at + 1 : begin + 16])))
            at //= 16
        return out

    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        by[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {name: levels([x[1] for x in by[name]]) for name in names}
    top = levels([trees[name][-1][0] for name in names]) if names else []
    out = []
    for place, name in enumerate(names):
        for at, (doc_id, node, r) in enumerate(by[name]):
            text, way = r["text"], path(trees[name], at) + path(top, place)
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % every == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            now = leaf(r, text)
            for left, right in way:
                now = sha(left + now + right)
            out.append((doc_id, node, trees[name][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), now, now == top[-1][0]))
    return sorted(out, key=str)


def audited(docs):
    return sorted((tuple(r) for r in merkle.audit(docs, merkle.tampered()).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 1}, {"a": 17, "b": 256}, {"a": 257, "B": 2, None: 15}, {"hot": 700, "x": 300}])
def test_manifest_of_sizes(spark, sizes):
    rows = [(n, f"Text {n}", "en", name) for n, name in enumerate(s for s, k in sizes.items() for _ in range(k))]
    docs = documents(spark, random.Random(2).sample(rows, len(rows)))
    found = audited(docs)
    assert found == brute_manifest([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in found if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5} <= {True}


def test_manifest_of_many_levels(spark):
    """A source of more than 256 blocks, and more than 256 sources."""
    source = F.when(F.col("id") < 66_000, "hot").otherwise(F.format_string("s%03d", F.pmod("id", F.lit(300))))
    docs = spark.range(67_000).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.lit("T").alias("text"))
    assert audited(docs) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_edges(spark):
    docs = awkward(spark)
    assert audited(docs) == brute_manifest([r.asDict() for r in docs.collect()])
    assert audited(docs.limit(0)) == []
    levels, _, root = merkle.manifest(docs.limit(0))
    assert root is None


def test_tree_by_appends_equals_whole_tree():
    for n in range(1, 257):
        nodes = [hashlib.sha256(f"{n} {k}".encode()).digest() for k in range(n)]
        root, witnesses = merkle.grown(b"".join(nodes), 0)
        assert root == merkle.root_of(nodes)
        assert all(merkle.fold(node, w.path()) == root for node, w in zip(nodes, witnesses))
        assert n < 3 or merkle.fold(nodes[0], witnesses[1].path()) != root
