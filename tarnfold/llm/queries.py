"""The registered queries of this package: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import chat, divergence, katz, langid, minhash, mixing, mpeg, pieces, pivots, prefixtrie, topk, toxicity, urlfilter
from tarnfold.llm.common import id_mod, table

#: The rules of op4, host and path prefix with a verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    got = mpeg.read(mpeg.store(docs, "data", keep=("doc_id", "n_bytes")), keep=("doc_id", "n_bytes"))
    size = F.octet_length("payload")
    show = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    parts = [("frames", F.col("frames")), ("seconds", F.concat_ws("/", F.col("duration_num"), F.col("duration_den"))), ("kbps", F.concat_ws("-", F.col("min_kbps"), F.col("max_kbps"))), ("table", F.concat_ws(":", F.col("table"), F.col("table_frames"), F.col("table_bytes"))), ("crc", F.concat_ws(":", F.col("crc_good"), F.col("crc_bad"))), ("sums", F.concat_ws(":", F.col("table_crc_ok"), F.col("audio_crc_ok"))), ("last", F.element_at("offsets", -1))]
    return got.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", *[F.concat(F.lit(f"{k}="), show(c)) for k, c in parts]).alias("feature"),
    )


def op4_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


OP4_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


#: Order of op5's model. Order 3, the operator's default, needs 2.41 GB of disk over 0.5 GB of texts, a little over the check tool's limit.
KATZ_ORDER = 2


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_mod("doc_id", 10) == 0).alias("held_out"))
    out, model = katz.learn(docs, ~F.col("held_out"), keep=("doc_id", "held_out"), order=KATZ_ORDER)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.words.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    out = chat.format_conversations(given.unionByName(more))
    turns = chat.read_turns(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), "formatted").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(role, '\', '\b'), '<', '\l') AS r, replace(replace(text, '\', '\b'), '<', '\l') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn>') + length(r) + length('<text>') + length(t) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The contract, exactly; the index finds all its links where its recall is whole, as on the tables of TESTDATA.md.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.y FROM r JOIN l ON r.reach = l.x),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out, _ = mixing.mix(docs, max_repeats=2.0)
    return out.select("doc_id", "source", "mix_pass", "mix_key", "mix_block")


def model_file() -> str:
    """Place of the public SentencePiece vocabulary; an installed file, alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = pieces.encode(docs, model_file(), keep=("doc_id", "text"))
    got = pieces.decode(ids, model_file(), keep=("doc_id", "text"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_mod("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (id_mod("doc_id", 5) == 0).alias("held_out"))
    return langid.identify(rows, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(id_mod("doc_id", 3) != 1))
    rows = docs.select("doc_id", "text", (id_mod("doc_id", 3) == 1).alias("held_out"))
    out = toxicity.score(rows, model, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_minhash_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, g.y FROM r JOIN both_ways g ON r.reach = g.x),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""

def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.shared_prefixes(table(spark, sf_dir, "conversations"))


#: crc32 of a conversation id's digits, which DuckDB has no function for.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, role, sha256(octet_length(encode(role)) || ':' || role || text) AS key, octet_length(encode(text)) AS bytes FROM t),
l AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, role, key) AS ks, list(bytes ORDER BY turn NULLS FIRST, role, key) AS bs FROM k GROUP BY conv_id),
h AS (SELECT *, {_CRC32} % 9 AS h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ks[1:h.h], []), h.ks[h.h + 1:]) AS ks, list_concat(coalesce(b.bs[1:h.h], []), h.bs[h.h + 1:]) AS bs FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(ks) AS n, array_to_string(ks[1:d], '') AS prefix, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], '') END AS above, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)),
g AS (SELECT d, prefix, above, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM p GROUP BY d, prefix, above),
c AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM g WHERE d > 0 GROUP BY d, above),
f AS (SELECT g.*, coalesce(c.n_children, 0) AS n_children FROM g LEFT JOIN c ON c.d = g.d AND c.prefix = g.prefix),
u AS (SELECT up AS d, left(prefix, CAST(64 * up AS BIGINT)) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM f) GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u ON u.d = f.d AND u.prefix = f.prefix LEFT JOIN g q ON q.d = f.d - 1 AND q.prefix = f.above
"""


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END AS BIGINT) AS score FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 20
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top_terms=10)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
n AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY w.lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(all_n)::BIGINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n)::BIGINT AS total FROM n GROUP BY lang, source),
x AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, (1 + (1000000000 * (coalesce(n.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v))::BIGINT AS p, (1 + (1000000000 * (k.all_n + 2)) // (l.lang_total + 2 * l.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM x WHERE n > 0 AND p > q),
k2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT * FROM k2 WHERE part = 'pair' OR rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_pivot_neighbours": op2_pivot_neighbours,
    "op3_temperature_mix": op3_temperature_mix,
    "op4_url_trie": op4_url_trie,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_chat_format": op6_chat_format,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_spans": op8_language_spans,
    "op9_toxicity_grammar": op9_toxicity_grammar,
    "op10_minhash_bottomk": op10_minhash_bottomk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_top_k": op12_top_k,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {"op2_pivot_neighbours": OP2_SQL, "op4_url_trie": OP4_SQL, "op6_chat_format": OP6_SQL, "op10_minhash_bottomk": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_top_k": OP12_SQL, "op13_source_divergence": OP13_SQL}
