"""The registered queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(read_table(spark, sf_dir, "documents"))


def op3_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orc_ids import ids_report, write_ids

    path = new_path(spark, "orc-ids")
    write_ids(read_table(spark, sf_dir, "documents"), path, tokenizer_file(WORD_BPE), end_id=1)
    return ids_report(spark, path)


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pretokens import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), limit=2048)


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_report, plan_records, write_archives

    folder = new_path(spark, "warc")
    write_archives(plan_records(read_table(spark, sf_dir, "pages")), folder).agg(F.sum("n_records")).collect()
    return archive_report(spark, folder)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_report

    return line_report(read_table(spark, sf_dir, "documents"), site="source")


def op10_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chroma import recording_report, tones

    return recording_report(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", tones).withColumnRenamed("id", "vec_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_report

    return cluster_report(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=1024, dim=64, k=8, seed="3", rounds=10)


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .veccodes import code_report

    return code_report(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", scale=256, dim=64, parts=16, entries=64, rounds=2)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_spans": op2_pii_spans,
    "op3_orc_token_ids": op3_orc_token_ids,
    "op7_minhash_near_duplicates": op7_minhash_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_chroma_fingerprints": op10_chroma_fingerprints,
    "op4_warc_archives": op4_warc_archives,
    "op5_source_mixing": op5_source_mixing,
    "op6_bpe_codec": op6_bpe_codec,
    "op11_toxicity": op11_toxicity,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_hamerly_codes": op13_hamerly_codes,
}

#: Vectors of finite components as integers; the floor of a division, for either sign.
_KEPT = """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)"""
_FLOOR = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT)"


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after another, each assigning every vector anew."""
    steps = [
        "WITH " + _KEPT.format(scale=1024),
        "x AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS y FROM s)",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS b FROM (SELECT r, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT b.c AS c, i, {_FLOOR} AS z FROM x JOIN a{n} USING (r) GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(z, y) AS y FROM c{n} LEFT JOIN m{n} USING (c, i))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return ",\n".join(steps) + f"""
        SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
          CAST(sum(b.d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN h ON h.c = b.c"""


def _codes_sql(entries: int = 64, rounds: int = 2) -> str:
    steps = [
        "WITH " + _KEPT.format(scale=256),
        "x AS MATERIALIZED (SELECT r, (i - 1) // 4 AS p, (i - 1) % 4 AS j, x FROM (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept))",
        f"s AS (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS e, v FROM kept WHERE vec_id IS NOT NULL QUALIFY e < {entries})",
        "c0 AS MATERIALIZED (SELECT e, (i - 1) // 4 AS p, (i - 1) % 4 AS j, y FROM (SELECT e, generate_subscripts(v, 1) AS i, unnest(v) AS y FROM s))",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'e': e}}) AS b FROM (SELECT r, p, e, sum((x - y) * (x - y)) AS d FROM x JOIN c{n} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT b.e AS e, p, j, {_FLOOR} AS z FROM x JOIN a{n} USING (r, p) GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT e, p, j, coalesce(z, y) AS y FROM c{n} LEFT JOIN m{n} USING (e, p, j))")
    return ",\n".join(steps) + f""",
        o AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
          (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) FROM c{rounds}) AS codebooks_sha256
        FROM o JOIN kept USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op12_delta_lloyd": _lloyd_sql(),
    "op13_hamerly_codes": _codes_sql(),
    "op4_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM h)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to,
          true AS intact
        FROM k""",
    "op9_line_dedup": r"""
        WITH d AS (SELECT doc_id, source, text, hash(text) AS k, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, k, source, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS raw FROM d),
        t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
        w AS (SELECT * FROM t WHERE regexp_matches(line, '([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]')),
        b AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM w GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 8),
        g AS (SELECT w.doc_id, w.k, w.pos FROM w JOIN b USING (line) WHERE NOT (w.doc_id = b.first.d AND w.pos = b.first.p)),
        s AS (SELECT l.doc_id, l.k, count(*) AS n_lines, count(g.pos) AS n_removed,
                string_agg(CASE WHEN g.pos IS NULL THEN raw END, chr(10) ORDER BY l.pos) AS kept
              FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k AND l.pos = g.pos GROUP BY l.doc_id, l.k)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
          CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(kept, '')) END AS text_md5
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id AND d.k = s.k""",
}
