"""The queries of this subpackage, with their SQL where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, decontaminate, linededup, quality, secrets, sharding, simhash, toxicity, urlfilter
from factloom.llm.common import table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), ranks_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("lang")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link(chat.as_calls(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "role", "kind", "call_id", "status", "level", "anchor_turn", "phase", "errors", F.sha2("json", 256).alias("json_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", F.col("live").alias("n_live"), F.col("copied").alias("n_copied"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_bpe, op3_line_dedup, op4_url_filter, op5_toxicity, op6_quality, op7_sharding, op8_chat, op9_decontamination, op10_secrets)
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = {
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op8_chat": """
WITH m AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations),
i AS (SELECT *, CASE kind WHEN 'call' THEN turn WHEN 'result' THEN turn - 1 END::VARCHAR AS call_id FROM m),
c AS (SELECT conv_id, call_id, min(turn) AS called FROM i WHERE kind = 'call' AND conv_id IS NOT NULL GROUP BY ALL),
-- A call comes after the call two turns before: its level is its place in the run of calls two turns apart.
p AS (SELECT *, called - 2 * row_number() OVER (PARTITION BY conv_id, called % 2 ORDER BY called) AS run FROM c),
v AS (SELECT conv_id, call_id, called, row_number() OVER (PARTITION BY conv_id, called % 2, run ORDER BY called) - 1 AS level FROM p),
r AS (SELECT conv_id, call_id, count(*) AS results FROM i WHERE kind = 'result' GROUP BY ALL)
SELECT i.conv_id, i.turn, i.role, i.kind, i.call_id,
       CASE kind WHEN 'call' THEN CASE WHEN results > 0 THEN 'answered' ELSE 'unanswered' END
                 WHEN 'result' THEN CASE WHEN called IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'message' END AS status,
       coalesce(level, 0) AS level,
       CASE WHEN kind = 'result' THEN coalesce(called, i.turn) ELSE i.turn END AS anchor_turn, CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS phase,
       CASE WHEN kind = 'call' THEN concat_ws(',', CASE WHEN text IS NULL THEN 'missing:chars' END, CASE WHEN length(text) > 300 THEN 'type:chars' END,
                                                   CASE WHEN i.turn % 4 = 0 THEN 'unknown:draft' END) ELSE '' END AS errors,
       sha256('{' || CASE WHEN kind = 'call' THEN '"arguments":{"chars":' || CASE WHEN text IS NULL THEN 'null' WHEN length(text) > 300 THEN '"' || length(text) || '"' ELSE length(text)::VARCHAR END
                          || CASE WHEN i.turn % 4 = 0 THEN ',"draft":true' ELSE '' END || ',"turn":' || i.turn || '},' ELSE '' END
         || '"content":' || coalesce(to_json(i.text)::VARCHAR, 'null') || CASE WHEN kind <> 'message' THEN ',"id":"' || i.call_id || '"' ELSE '' END
         || ',"role":"' || i.role || '"' || CASE WHEN kind = 'call' THEN ',"tool":"reply"' ELSE '' END || '}') AS json_sha256
FROM i LEFT JOIN v ON i.conv_id = v.conv_id AND i.call_id = v.call_id LEFT JOIN r ON i.conv_id = r.conv_id AND i.call_id = r.call_id""",
}
