"""The corpus operators' queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, line_dedup, near_dup, oracle, packing, pii, runs, substring_dedup, token_counts, token_files, toxicity, transport, vector_codes
from .common import table, tokenizer_path


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_features(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, room=2048)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_figures(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.figures(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.figures(runs.planted(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.coded(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_transport_streams,
        op3_substring_dedup,
        op4_language_id,
        op5_packing,
        op6_token_files,
        op7_toxicity,
        op8_token_counts,
        op9_line_dedup,
        op10_decontamination,
        op11_private_data,
        op12_periodic_runs,
        op13_vector_codes,
    )
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Where SQL can say it; a document is a row with a doc_id of its own, as in the tables.
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORDS}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)""",
    "op3_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents),
p AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS at_word FROM p JOIN f USING (h) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at_word FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.at_word) AS kept, count(*) AS n FROM u ANTI JOIN g ON g.doc_id = u.doc_id AND g.at_word = u.at_word GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PLAIN}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PLAIN}'), []) AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, k, n, item_id FROM p JOIN i USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS at_word FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)""",
}
ORACLE_SQL |= oracle.SQL
