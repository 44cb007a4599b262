"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.alignment import public_alignment
from gneiss.llm.chat import chat_windows, read_back
from gneiss.llm.embeddings import embedding_groups
from gneiss.llm.exact_dedup import exact_dedup
from gneiss.llm.html_text import main_text
from gneiss.llm.language_model import lm_scores
from gneiss.llm.licences import licence_scan
from gneiss.llm.mixing import mix
from gneiss.llm.packing import pack
from gneiss.llm.personal import personal_digests
from gneiss.llm.runs import run_digests
from gneiss.llm.simhash import simhash_groups
from gneiss.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op3_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


#: A conversation whose texts hold a chat template's own marks.
TRAP = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(turns.unionByName(trap)))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_alignment(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digests(_table(spark, sf_dir, "documents"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_simhash_groups, op2_lm_scores, op3_embedding_groups, op4_source_mix, op5_best_fit_packing, op6_chat_windows, op7_main_text,
        op8_exact_dedup, op9_toxicity, op10_licence_scan, op11_tokenizer_alignment, op12_personal_data, op13_word_runs,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


ORACLES = {
    "op6_chat_windows": r"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(replace(text, '\', '\s'), '#', '\h'), '<', '\l'), ':', '\c') AS x,
              length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 AS size,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
        s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) - size AS before, 4 + length(role) + 2 + length(x) + 8 AS width, n = 1 AND role = 'system' AS is_system FROM e),
        k AS (SELECT *, coalesce(sum(CASE WHEN is_system THEN 0 ELSE size END) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING), 0) AS kept,
              max(CASE WHEN is_system THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS rules, before // 65536 AS section FROM s),
        c AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN rules + kept + size <= 1024 THEN 2 WHEN rules + size <= 1024 THEN 1 ELSE 0 END AS repeats FROM k),
        g AS (SELECT conv_id, n, size AS used, 0 AS own, true AS opens, section FROM c WHERE n = 1
              UNION ALL SELECT c.conv_id, c.n,
                  CASE WHEN c.section <> g.section OR g.used + c.size > 1024 THEN c.size + CASE WHEN repeats > 0 THEN rules ELSE 0 END + CASE WHEN repeats = 2 THEN kept ELSE 0 END ELSE g.used + c.size END,
                  g.own + CASE WHEN c.section <> g.section OR g.used + c.size > 1024 THEN 1 ELSE 0 END, c.section <> g.section OR g.used + c.size > 1024, c.section
              FROM g JOIN c ON c.conv_id = g.conv_id AND c.n = g.n + 1),
        w AS (SELECT c.*, g.own, g.opens FROM c JOIN g ON c.conv_id = g.conv_id AND c.n = g.n),
        v AS (SELECT conv_id, own, n, before, repeats FROM w WHERE opens AND repeats > 0),
        h AS (SELECT v.conv_id, sum(w.width) AS chars FROM v JOIN w ON w.conv_id = v.conv_id AND w.n < v.n AND w.before >= v.before - 256 AND NOT w.is_system WHERE v.repeats = 2 GROUP BY v.conv_id),
        r AS (SELECT v.conv_id, sum(w.width) AS chars FROM v JOIN w ON w.conv_id = v.conv_id AND w.is_system GROUP BY v.conv_id),
        d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
              sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS loss_chars,
              sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256, sum(width) AS chars FROM w GROUP BY conv_id)
        SELECT d.conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
            CAST(d.chars + coalesce(h.chars, 0) + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars
        FROM d LEFT JOIN h USING (conv_id) LEFT JOIN r USING (conv_id)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
}
