"""Queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hamming, html, infilling, interactions, jaccard, language, packing, pii, quality, sentencepiece, topk, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


@query("op1_sentencepiece_lattice")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    coded = sentencepiece.encode(table(spark, folder, "documents"), keep=["doc_id"])
    back = sentencepiece.decode(coded)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_html_block_labeller")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html.main_text(pages, html.fit(pages))


@query("op3_bit_sliced_top_k", """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = topk.quantised(table(spark, folder, "embeddings"), scale=64.0)
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


@query("op4_warc_zstd", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex, n) AS first
  FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, folder, "pages"), min_bytes=0)
    return warc.read_archives(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_pii_anchor_expansion")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_report(table(spark, folder, "documents"))


@query("op6_quality_empirical_bayes")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "p_low", "p_toxic", "keep")


@query("op7_itq_hamming_dedup", """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS top FROM embeddings UNION SELECT l.b, r.top FROM reach r JOIN links l ON r.id = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v JOIN (SELECT id, min(top) AS component_id FROM reach GROUP BY id) c ON c.id = v.vec_id
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, folder, "embeddings"), threshold=0.98)


@query("op8_multi_order_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS top FROM documents UNION SELECT l.b, r.top FROM reach r JOIN links l ON r.id = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT id, min(top) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"), size=4, percent=85)


@query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, folder, "documents")))


@query("op10_chat_formatting", rf"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(text, '{chat.CONTROL}', '\1\2~\3\4', 'g') AS escaped,
         row_number() OVER w AS place, lag(role) OVER w AS before, lead(role) OVER w AS after, lead(turn) OVER w AS next_turn
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(escaped)
            + CASE WHEN place > 1 AND before = role THEN 6 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 5 ELSE 12 + length(role) END
            + CASE WHEN next_turn IS NOT NULL AND after = role THEN 0 WHEN role = 'assistant' THEN 4 ELSE 7 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


@query("op11_fenwick_infilling", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (
  SELECT *, ('0x' || substr(hex, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(hex, 9, 8))::BIGINT % (n + 1) AS h2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(hex, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(hex, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (SELECT doc_id, t, n, form, least(h1, h2)::BIGINT AS a, greatest(h1, h2)::BIGINT AS b FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return infilling.report(table(spark, folder, "documents"))


@query("op12_removal_potential", r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 50, 100 * list_unique(w) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN said ON w.doc_id = said.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
met AS (
  SELECT part, good, toxic, fails, filter_order, places,
         coalesce(list_position(list_transform(places, lambda p: fails[p]), true), 6) AS gone
  FROM f, orders),
steps AS (
  SELECT part, filter_order, step::INT AS step, places[step] AS own,
         count(*) FILTER (gone > step)::BIGINT AS kept, count(*) FILTER (gone = step)::BIGINT AS removed,
         count(*) FILTER (gone < step AND fails[places[step]])::BIGINT AS redundant,
         count(*) FILTER (fails[places[step]] AND len(list_filter(fails, lambda x: x)) = 1)::BIGINT AS unique_fails,
         count(*) FILTER (gone = step AND good)::BIGINT AS good_lost, count(*) FILTER (gone = step AND toxic)::BIGINT AS toxic_lost
  FROM met, range(1, 6) s(step) GROUP BY part, filter_order, step, places)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM steps
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(interactions.failures(table(spark, folder, "documents"), table(spark, folder, "labels")))


@query("op13_compression_language_id")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return language.report(table(spark, folder, "documents"))
