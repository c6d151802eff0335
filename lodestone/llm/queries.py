"""The queries of this subpackage and their SQL: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, chat, contamination, exact, license_scan, lines, quality, secret_scan, simhash, token_counts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_totals(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = contamination.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(turns.union(own))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are kept, with their evidence: those that the classifier rejects are not in the result."""
    found = quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.where("kept").select("doc_id", "host", "path", "p", "site_rate", "q")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_secret_scan, op3_line_dedup, op4_bpe, op5_token_counts, op6_license_scan, op7_decontamination, op8_exact_dedup, op9_chat_format, op10_quality)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESC = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"

_TRIMMED = r"trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"

ORACLE_SQL = {
    "op3_line_dedup": rf"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents),
        pos AS (SELECT doc_id, unnest(l) raw, unnest(range(0, len(l))) line_no FROM docs),
        lines AS (SELECT doc_id, line_no, raw, {_TRIMMED} AS line FROM pos),
        firsts AS (SELECT line, min((doc_id, line_no)) AS spot FROM lines WHERE length(line) >= 10 GROUP BY 1),
        cut AS (SELECT line, spot, i, hash(line[:i - 1] || line[i + 1:]) h FROM (SELECT *, unnest(range(1, length(line) + 1)) i FROM firsts)),
        close AS (SELECT a.line, a.spot FROM cut a JOIN cut b ON a.h = b.h AND a.i = b.i AND a.spot > b.spot WHERE levenshtein(a.line, b.line) <= 1
                  UNION SELECT a.line, a.spot FROM cut a JOIN firsts b ON a.h = hash(b.line) AND a.spot > b.spot WHERE levenshtein(a.line, b.line) <= 1
                  UNION SELECT a.line, a.spot FROM firsts a JOIN cut b ON hash(a.line) = b.h AND a.spot > b.spot WHERE levenshtein(a.line, b.line) <= 1),
        stay AS (SELECT spot FROM firsts WHERE line NOT IN (SELECT line FROM close)),
        kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS text, count(*) n FROM lines WHERE length(line) < 10 OR (doc_id, line_no) IN (SELECT spot FROM stay) GROUP BY 1)
        SELECT doc_id, len(l)::BIGINT n_lines, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END n_kept, sha256(coalesce(text, '')) text_sha256 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": rf"""
        WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(len(w), 13) l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') g
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) i FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
        p AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
        h AS (SELECT p.doc_id, p.i, p.l, win.item_id FROM p JOIN win ON win.l = p.l AND win.g = array_to_string(p.w[p.i:p.i + p.l - 1], ' ')),
        c AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) k FROM h) GROUP BY doc_id),
        n AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) items FROM h GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) keep_id, count(*) OVER (PARTITION BY text_sha256) group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 FROM k""",
    "op9_chat_format": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) loss_sha256,
               sum(20 + length({_ESC.format('role')}) + length({_ESC.format('text')}))::BIGINT formatted_chars
        FROM c GROUP BY conv_id""",
}
