"""The queries opN_<name> and pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decode, encode
from .chat_format import Parameter, link_tool_calls
from .common import table, vocabulary
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restored
from .manifest import folded, leaf_digest, manifest, proof_digest
from .near_dedup import hex_digits, near_dedup
from .packing import pack
from .substring_dedup import substring_dedup
from .suffix_tree_lm import lm_scores
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filter import url_filter


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    p = F.col("probabilities")
    return out.select("doc_id", p[0].alias("p_low_quality"), p[1].alias("p_toxic"), "toxic")


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return lm_scores(table(spark, sf_dir, "documents"), held_out)


#: (verdict, host, path without its first /), as the query's contract names them.
URL_RULES = [
    ("block", "com", "en/"),
    ("allow", "example.com", "en/7"),
    ("allow", "net", "de/"),
    ("block", "example.net", "de/8"),
    ("block", "org", "es/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table says which pages are bad: the verdicts of the query's own rules are the labels that more rules are mined from."""
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), None, None, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined_rule.tokens", " ").alias("mined_tokens"))


#: The one tool of the query: what it may be given.
REPLY_TOOL = {"reply": {"after": Parameter("string"), "prompt": Parameter("string", required=True, longest=2000), "turn": Parameter("integer", required=True)}}


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is a call of the tool `reply`, which needs the user's turn before; the assistant's next turn is its result."""
    call_id = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, role = F.col("turn"), F.col("role")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(role == "user", "call").when(role == "assistant", "result").otherwise("message").alias("kind"),
        F.when(role == "user", call_id(turn)).when(role == "assistant", call_id(turn - 1)).alias("id"),
        F.when(role == "user", "reply").otherwise(role).alias("name"),
        F.when(role == "user", F.to_json(F.struct(F.when(turn >= 2, call_id(turn - 2)).alias("after"), F.col("text").alias("prompt"), turn))).otherwise(F.col("text")).alias("payload"),
        F.when((role == "user") & (turn >= 2), F.array(call_id(turn - 2))).alias("after"),
    )
    return link_tool_calls(turns, REPLY_TOOL).withColumn("errors", F.array_join("errors", "; "))


OP5_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'call-' || conv_id || '-' || turn WHEN 'assistant' THEN 'call-' || conv_id || '-' || (turn - 1) END AS id,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS need
  FROM conversations),
ids AS (
  SELECT id, min(turn) FILTER (kind = 'call') AS called, min(turn) FILTER (kind = 'result') AS answered,
    count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results
  FROM t WHERE id IS NOT NULL GROUP BY id),
calls AS (SELECT DISTINCT t.id, n.id AS need FROM t LEFT JOIN ids n ON t.need = n.id AND n.calls > 0 WHERE t.kind = 'call' AND t.id IS NOT NULL),
l AS (SELECT id, 0 AS level FROM calls WHERE need IS NULL UNION ALL SELECT c.id, l.level + 1 FROM calls c JOIN l ON c.need = l.id)
SELECT t.conv_id, t.turn, t.kind, t.id, CASE kind WHEN 'call' THEN i.answered WHEN 'result' THEN i.called END AS partner_turn,
  CASE WHEN i.calls > 0 AND kind <> 'message' THEN l.level ELSE 0 END AS level,
  CASE kind WHEN 'call' THEN concat_ws('; ',
      CASE WHEN i.calls > 1 THEN 'repeated id' END,
      CASE WHEN i.answered IS NULL THEN 'no result' END,
      CASE WHEN i.answered <= turn THEN 'result before call' END,
      CASE WHEN need IS NOT NULL AND n.called IS NULL THEN 'unknown need' END,
      CASE WHEN text IS NULL THEN 'missing: prompt' END,
      CASE WHEN length(text) > 2000 THEN 'too long: prompt' END)
    WHEN 'result' THEN concat_ws('; ', CASE WHEN i.called IS NULL THEN 'no call' END, CASE WHEN i.results > 1 THEN 'repeated result' END)
    ELSE '' END AS errors,
  CASE kind WHEN 'call' THEN '{"arguments":{' || coalesce('"after":' || to_json(need) || ',', '') || coalesce('"prompt":' || to_json(text) || ',', '') || '"turn":' || turn || '},"id":' || to_json(t.id) || ',"name":"reply","type":"call"}'
    WHEN 'result' THEN '{' || coalesce('"content":' || to_json(text) || ',', '') || '"id":' || to_json(t.id) || ',"type":"result"}'
    ELSE '{' || coalesce('"content":' || to_json(text) || ',', '') || coalesce('"role":' || to_json(role) || ',', '') || '"type":"message"}' END AS json
FROM t LEFT JOIN ids i ON t.id = i.id LEFT JOIN ids n ON t.need = n.id LEFT JOIN l ON t.id = l.id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_digits(out.fp).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH lowered AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
items AS (SELECT DISTINCT id, ws, least(10, len(ws)) AS m FROM w WHERE kind = 'i' AND len(ws) > 0),
wanted AS (SELECT DISTINCT id AS item, m, array_to_string(ws[i:i + m - 1], ' ') AS window_words FROM items, LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i)),
asked AS (SELECT id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS window_words FROM w, (SELECT DISTINCT m FROM items) s, LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i) WHERE kind = 'd'),
found AS (SELECT id, item, i, asked.m FROM asked JOIN wanted USING (m, window_words)),
hits AS (SELECT id, count(DISTINCT p) AS n FROM found, LATERAL (SELECT unnest(range(i, i + m)) AS p) GROUP BY id),
named AS (SELECT id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY id)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hits h ON h.id = w.id LEFT JOIN named n ON n.id = w.id WHERE w.kind = 'd'
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
f AS (SELECT h, min(doc_id) AS lo FROM s GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM s JOIN f USING (h), LATERAL (SELECT unnest(range(i, i + 50)) AS p) WHERE lo < doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
r AS (SELECT *, len(units) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS hs FROM d),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = leaf_digest(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns))
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 0
    out = manifest(table(spark, sf_dir, "documents"), columns, "lang", more={"tampered": F.when(tampered, altered)})
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS raw,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS changed,
    xor(4294967295, list_reduce(flatten([[(ord(c) >> k) & 1 FOR k IN range(8)] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda held, bit: CASE WHEN xor(held, bit) & 1 = 1 THEN xor(held >> 1, 3988292384) ELSE held >> 1 END, 4294967295)) % 7 = 0 AS tampered
  FROM documents),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
    sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN raw], '')) AS leaf,
    sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN CASE WHEN tampered THEN changed ELSE raw END], '')) AS given FROM fields),
node AS (
  SELECT lang, 0 AS level, i, count(*) OVER (PARTITION BY lang) AS n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, level, n, i // 2),
sub AS (SELECT lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, digest FROM sub
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, n, i // 2),
steps AS (
  SELECT l.doc_id, n.level, CASE WHEN (l.i >> n.level) % 2 = 1 THEN '<' ELSE '>' END AS side, s.digest
  FROM leaves l JOIN node n ON n.lang IS NOT DISTINCT FROM l.lang AND n.n > 1 AND n.i = l.i >> n.level
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = n.level AND s.i = xor(n.i, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + t.level, CASE WHEN (b.i >> t.level) % 2 = 1 THEN '<' ELSE '>' END, s.digest
  FROM leaves l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.n > 1 AND t.i = b.i >> t.level
  LEFT JOIN top s ON s.level = t.level AND s.i = xor(t.i, 1)),
proof AS (SELECT doc_id, list(side || coalesce(digest, '') ORDER BY level) AS path FROM steps GROUP BY doc_id),
done AS (
  SELECT l.doc_id, l.leaf, b.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(array_to_string([x[2:] FOR x IN coalesce(path, [])], '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda held, x: CASE WHEN x[1] = '<' THEN sha256(x[2:] || held) ELSE sha256(held || x[2:]) END, given) AS folded_root
  FROM leaves l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proof p ON p.doc_id = l.doc_id)
SELECT *, folded_root = root AS verified FROM done
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path, PATTERN), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_dedup": op1_exact_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_tree_lm": op3_suffix_tree_lm,
        "op4_url_filter": op4_url_filter,
        "op5_tool_calls": op5_tool_calls,
        "op6_simhash": op6_simhash,
        "op7_decontamination": op7_decontamination,
        "op8_token_counts": op8_token_counts,
        "op9_packing": op9_packing,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_tool_calls": OP5_SQL, "op7_decontamination": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
