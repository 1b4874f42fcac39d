"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm import (
    audit, bpe, chat, decontaminate, embeddings, licenses, middle, quality, samples, simhash, substrings, tokens, toxicity,
    urls,
)
from coterie.session import scratch_path

#: (host, path, verdict) of the registered URL filter.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: The id that the rank file leaves free.
SEPARATOR = 50256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def op1_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark, sf):
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_chats(rows.unionByName(extra)).withColumns({
        "turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss_text(F.col("formatted"), F.col("loss_mask"))})
    told = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op3_simhash(spark, sf):
    return simhash.near_groups(texts(spark, sf))


def op4_token_count(spark, sf):
    encoded = bpe.encode_texts(texts(spark, sf), RANKS, PATTERN)
    return tokens.token_counts(encoded, scratch_path(spark, "token-files"), SEPARATOR)


def op5_toxicity(spark, sf):
    docs = texts(spark, sf)
    model = toxicity.train(docs, table(spark, sf, "labels"))
    return _judged(toxicity.score(docs, model), 0.7)


def op6_substring_dedup(spark, sf):
    out = substrings.remove_duplicate_spans(texts(spark, sf), without=("text",))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark, sf):
    return token_digests(bpe.decode_ids(bpe.encode_texts(texts(spark, sf), RANKS, PATTERN), RANKS, PATTERN))


def token_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality(spark, sf):
    docs = texts(spark, sf)
    field = quality.train(docs, table(spark, sf, "labels"))
    return _judged(quality.score(docs, field, without=("text",)), 0.5)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (samples.fold() == 1).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_decontaminate(spark, sf):
    out = decontaminate.contamination(texts(spark, sf), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_embedding_dedup(spark, sf):
    return embeddings.near_vectors(table(spark, sf, "embeddings"))


def op11_license_scan(spark, sf):
    out = licenses.license_labels(texts(spark, sf), without=("text",))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")


def op12_fill_in_middle(spark, sf):
    out = middle.fill_in_middle(texts(spark, sf))
    back = middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(back, 256).alias("restored_sha256"))


def op13_filter_audit(spark, sf):
    return audit.filter_audit(table(spark, sf, "documents").select("doc_id", "text", "lang"), table(spark, sf, "labels"))


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  without it this subpackage is not whole

    return {q.__name__: q for q in (
        op1_url_filter, op2_chat_format, op3_simhash, op4_token_count, op5_toxicity, op6_substring_dedup, op7_byte_bpe,
        op8_quality, op9_decontaminate, op10_embedding_dedup, op11_license_scan, op12_fill_in_middle, op13_filter_audit,
        pipeline)}


# --- DuckDB -----------------------------------------------------------------

_WHITE = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(n)),
e AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\])', '\1+', 'g')) AS n,
    length(regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\])', '\1+', 'g')) AS role_n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before = role THEN 7 ELSE role_n + 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '""" + _WHITE + r"""') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS words FROM p),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS k FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE k > 1),
gone AS (SELECT doc_id, list(i) AS i FROM x GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, len(coalesce(i, [])) AS n_removed, w, coalesce(i, []) AS i FROM d LEFT JOIN gone USING (doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM k),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text
         FROM words ANTI JOIN x ON words.doc_id = x.doc_id AND words.pos = x.i GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM k LEFT JOIN kept USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS words FROM (
         SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bn)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words FROM (
         SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN bw ON dw.words = bw.words AND dw.n = bw.n),
x AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP10 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '""" + _UNIT + r"""') AS u,
             sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""

OP13 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '""" + _WHITE + r"""') AS w
  FROM documents),
f AS (
  SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
k AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS i, [ascii(y) - 64 FOR y IN string_split(filter_order[1:step - 1], '') IF y <> ''] AS e
      FROM o, range(1, 6) s(step) WHERE length(filter_order) = 5),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
r AS (
  SELECT part, filter_order, step, i, n, good, toxic, fails[i] AS now, len(list_filter(e, lambda j: fails[j])) > 0 AS earlier,
    len(list_filter(fails, lambda y: y)) AS many FROM c, k),
s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, chr(64 + CAST(any_value(i) AS INTEGER)) AS filter,
    CAST(coalesce(sum(n) FILTER (NOT now AND NOT earlier), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (now AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (now AND earlier), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (now AND many = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (now AND NOT earlier), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (now AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s
"""


def oracle_sql() -> dict[str, str]:
    """Fingerprints, tokens and models have no SQL; tests hold them against brute force,
    round trips and held-out labels."""
    return {"op1_url_filter": OP1, "op2_chat_format": OP2, "op6_substring_dedup": OP6, "op9_decontaminate": OP9,
            "op10_embedding_dedup": OP10, "op12_fill_in_middle": OP12, "op13_filter_audit": OP13}
