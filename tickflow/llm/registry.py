"""Queries of the training-data operators, with SQL where DuckDB can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_duplicates

    found = line_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import read_token_files, write_token_files

    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predicted

    return predicted(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_tokens": op8_tokens,
    "op9_langid": op9_langid,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_quality": op12_quality,
    "op13_vector_codes": op13_vector_codes,
}


def _moved(k: int) -> str:
    """Common tables of operator 13 that assign parts to codebook ``k`` and move its entries to make the next one."""
    return f"""
        near{k} AS ({_nearest(k)}),
        means{k} AS (
            SELECT p, e, list(m ORDER BY j) AS c FROM (
                SELECT n.p, e, j, (sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM near{k} n JOIN parts USING (vec_id, p), LATERAL unnest(range(1, len(x) + 1)) AS r(j) GROUP BY ALL) GROUP BY ALL),
        book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))"""


def _nearest(k: int) -> str:
    distance = "list_sum([(x[j] - c[j]) * (x[j] - c[j]) FOR j IN range(1, len(x) + 1)])"
    return f"SELECT vec_id, p, min(d)::bigint AS d, arg_min(e, d * 64 + e) AS e FROM (SELECT vec_id, a.p, e, {distance}::bigint AS d FROM parts a JOIN book{k} b ON a.p = b.p) GROUP BY ALL"


ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_line_dedup": r"""
        WITH split_lines AS (
            SELECT doc_id, pos, lines[pos] AS line,
                   translate(trim(lines[pos], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), LATERAL unnest(range(1, len(lines) + 1)) AS r(pos)),
        repeated AS (
            SELECT key, min(doc_id) AS first_id FROM split_lines WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        marked AS (
            SELECT s.doc_id, pos, line, r.key IS NOT NULL AND s.doc_id > first_id AS gone
            FROM split_lines s LEFT JOIN repeated r ON s.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op11_fill_in_middle": """
        WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
        drawn AS (
            SELECT doc_id, t, n, ('0x' || h[1:8])::bigint % (n + 1) AS a, ('0x' || h[9:16])::bigint % (n + 1) AS b,
                   t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::bigint % 100 >= 90 AS plain,
                   ('0x' || h[25:32])::bigint % 100 < 20 AS spm
            FROM hashed),
        parted AS (SELECT *, t[:least(a, b)] AS prefix, substring(t, least(a, b) + 1, abs(a - b)) AS middle, substring(t, greatest(a, b) + 1) AS suffix FROM drawn)
        SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN least(a, b) END AS prefix_chars, CASE WHEN NOT plain THEN abs(a - b) END AS middle_chars,
               sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                      ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM parted""",
    "op13_vector_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, [floor(256 * x::double)::bigint FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        parts AS (SELECT vec_id, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM kept, LATERAL unnest(range(16)) AS r(p)),
        book0 AS (SELECT p, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
        {_moved(0)}, {_moved(1)}, near2 AS ({_nearest(2)}),
        coded AS (SELECT vec_id, string_agg(lower(format('{{:02x}}', e)), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM near2 GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)""",
}
