"""The opN_ queries, each a thin digest of its operator's output, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import byte_bpe, centroids, chat_format, embedding_dedup, language_id, merkle, mixing, multi_index, piece_counts, simhash, token_store, url_filter, warc

ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(key) AS digest, row_number() OVER (PARTITION BY key) - 1 AS number
  FROM (SELECT *, coalesce('1' || doc_id, '0') || chr(10) || coalesce('1' || source, '0') || chr(10) || coalesce('1' || text, '0') AS key FROM documents)
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source
), w AS (
  SELECT source, source_size, ((r - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM per
), ranked AS (
  SELECT *, row_number() OVER o AS k,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
    (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), levels AS (
  SELECT *, (total - cap_before) / (weights - weight_before) AS level FROM ranked
), opened AS (
  SELECT min(k) AS k FROM levels WHERE level * weight <= cap
), targets AS (
  SELECT source, source_size,
    CASE WHEN l.k < (SELECT k FROM opened) THEN cap
         ELSE (SELECT level FROM levels WHERE k = (SELECT k FROM opened)) * weight END AS target
  FROM levels l
), rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || digest || ':' || number), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op3_warc"] = r"""
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE_SQL["op4_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*)::BIGINT AS n_links FROM link GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_messages(chat_format.text_parts(messages.unionByName(extra))))


ORACLE_SQL["op6_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT *, length(text) + length(role) + length('<s>[TURN ][/TURN]</s>')
    + length(regexp_replace(role || text, '[^\\\[\]<>]', '', 'g')) AS formatted FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: The rules of the contract.
URL_RULES = (
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.store(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL["op12_centroids"] = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), first AS (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1)::INT AS k, v FROM v
  QUALIFY k < 8
), rounds AS (
  SELECT 0 AS r, list(v ORDER BY k) AS c FROM first
  UNION ALL
  SELECT any_value(r) + 1, list(coalesce(moved, c[k + 1]) ORDER BY k) FROM (
    SELECT o.r, o.c, o.k, n.moved FROM (SELECT r, c, unnest(range(len(c)))::INT AS k FROM rounds WHERE r < 10) o
    LEFT JOIN (
      SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS moved FROM (
        SELECT k, j, sum(v[j])::BIGINT AS s, count(*)::BIGINT AS n FROM (
          SELECT v, list_min(list_transform(range(len(c)), lambda q: {'d': list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[q + 1][j]) * (v[j] - c[q + 1][j])))::BIGINT, 'q': q::INT})).q AS k
          FROM v, rounds WHERE r < 10), range(1, 65) t(j) GROUP BY k, j) GROUP BY k) n ON n.k = o.k)
  HAVING count(*) > 0
), placed AS (
  SELECT vec_id, c, list_min(list_transform(range(len(c)), lambda q: {'d': list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[q + 1][j]) * (v[j] - c[q + 1][j])))::BIGINT, 'q': q::INT})) AS m
  FROM v, rounds WHERE r = 10
)
SELECT vec_id, m.q AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.q))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c[m.q + 1], ',')) AS centroid_sha256
FROM placed
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.audit(docs, merkle.tampered())


#: A source's nodes carry its number (place), levels from 0; the tree over the sources has place -1.
_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda text: f"sha256({_FIELD('doc_id')} || {_FIELD('source')} || {_FIELD('lang')} || {_FIELD('n_chars')} || {_FIELD(text)})"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)::BIGINT), 4294967295)"
_TREE = lambda name, start: f"""{name} AS (
  {start}
  UNION ALL
  SELECT place, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY place) AS n FROM {name}) WHERE n > 1 GROUP BY place, level, pos // 16
)"""  # noqa: E731
ORACLE_SQL["op13_merkle"] = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, {_LEAF('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF("translate(text, '" + merkle.UPPER + "', '" + merkle.LOWER + "')")} ELSE {_LEAF('text')} END AS now,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY place) AS n FROM docs
), {_TREE("grown", "SELECT place, 0 AS level, pos, leaf AS node FROM leaves")},
tops AS (SELECT place, max(level) AS height, arg_max(node, level) AS subroot FROM grown GROUP BY place),
{_TREE("over", "SELECT -1::BIGINT AS place, 0 AS level, place AS pos, subroot AS node FROM tops")},
root AS (SELECT arg_max(node, level) AS root, max(level) AS height FROM over),
runs AS MATERIALIZED (SELECT place, level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM (SELECT * FROM grown UNION ALL SELECT * FROM over) GROUP BY ALL),
walk AS (
  SELECT l.doc_id, l.leaf, t.subroot, l.place AS own, t.height, 0 AS step, CASE WHEN t.height = 0 THEN l.place ELSE l.pos END AS spot, l.now AS folded, '' AS told
  FROM leaves l JOIN tops t USING (place)
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.own, w.height, w.step + 1, CASE WHEN w.step + 1 = w.height THEN w.own ELSE w.spot // 16 END,
    sha256(array_to_string(r.nodes[:w.spot % 16], '') || w.folded || array_to_string(r.nodes[w.spot % 16 + 2:], '')),
    w.told || array_to_string(r.nodes[:w.spot % 16], '') || array_to_string(r.nodes[w.spot % 16 + 2:], '')
  FROM walk w, root o, runs r
  WHERE w.step < w.height + o.height AND r.place = CASE WHEN w.step < w.height THEN w.own ELSE -1 END
    AND r.level = CASE WHEN w.step < w.height THEN w.step ELSE w.step - w.height END AND r.run = w.spot // 16
)
SELECT doc_id, leaf, subroot, root, sha256(told) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk, root WHERE step = walk.height + root.height
"""


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_simhash, op3_warc, op4_embedding_dedup, op5_token_counts, op6_chat_format, op7_language_id, op8_byte_bpe, op9_url_filter, op10_multi_index, op11_token_store, op12_centroids, op13_merkle)
}
