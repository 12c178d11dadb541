"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm.ann import nearest
from lodeframe.llm.embedding_dedup import embedding_links
from lodeframe.llm.jaccard import jaccard_links
from lodeframe.llm.language import language_id
from lodeframe.llm.merkle import merkle_manifest
from lodeframe.llm.packing import pack
from lodeframe.llm.phrase_dedup import phrase_dedup
from lodeframe.llm.pii import personal
from lodeframe.llm.quality import quality
from lodeframe.llm.sentencepiece import round_trip
from lodeframe.llm.sharding import sharded
from lodeframe.llm.suffix_dedup import suffix_dedup
from lodeframe.llm.tables import read
from lodeframe.llm.vector_codes import vector_codes


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id % 20 = 0")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_ann": op5_ann,
    "op6_quality": op6_quality,
    "op7_phrase_dedup": op7_phrase_dedup,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_language_id": op11_language_id,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _lloyd_sql(rounds: int = 6) -> str:
    """Lloyd's rounds as one CTE each."""
    lloyd = "".join(f"""
    ), a{t} AS (
        SELECT vec_id, label, p, v, k, d FROM (SELECT w.*, c.k, CAST(list_sum(list_transform(list_zip(w.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts w JOIN c{t} c ON w.p = c.p)
        QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1""" + ("" if t == rounds else f"""
    ), m{t} AS (
        SELECT p, k, list(m ORDER BY i) AS v FROM (
            SELECT p, k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM a{t}, range(1, (SELECT len(v) + 1 FROM parts LIMIT 1)) AS r(i) GROUP BY p, k, i
        ) GROUP BY p, k
    ), c{t + 1} AS (
        SELECT c{t}.p, c{t}.k, coalesce(m{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN m{t} ON c{t}.p = m{t}.p AND c{t}.k = m{t}.k""") for t in range(rounds + 1))
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)
    ), parts AS (
        SELECT vec_id, label, p, e[p * (len(e) // 8) + 1 : (p + 1) * (len(e) // 8)] AS v FROM kept, range(8) AS r(p)
    ), c0 AS (
        SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16){lloyd}
    ), books AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds}
    ), codes AS (
        SELECT vec_id, label, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, books
    """


#: DuckDB twins, where SQL can express the result.
ORACLE: dict[str, str] = {
    "op1_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(u, v) AS (
            SELECT vec_id, vec_id FROM vectors
            UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
        ), roots AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u)
        SELECT roots.vec_id, (SELECT count(*) FROM links WHERE links.u = roots.vec_id) AS n_links,
               component_id, roots.vec_id = component_id AS kept FROM roots
    """,
    "op5_ann": """
        WITH vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_vector_codes": _lloyd_sql(),
    "op13_merkle_manifest": """
        WITH RECURSIVE texts AS (
            SELECT doc_id, lang, text, concat(
                coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
                coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head
            FROM documents
        ), bits AS (
            SELECT *, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: (CAST(ascii(c) AS BIGINT) >> i) & 1))) AS bits FROM texts
        ), leaves AS (
            SELECT doc_id, lang, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
                   CASE WHEN xor(list_reduce(list_prepend(4294967295, bits), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 3 = 0
                        THEN sha256(concat(head, coalesce(concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-'))) END AS changed
            FROM bits
        ), entries AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
        ), trees(lang, height, pos, digest, n) AS (
            SELECT lang, 0, pos, leaf, n FROM entries
            UNION ALL SELECT lang, height + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM trees WHERE n > 1 GROUP BY lang, height, pos // 8, n
        ), subroots AS (
            SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM trees WHERE n = 1
        ), tops(height, pos, digest, n) AS (
            SELECT 0, pos, digest, n FROM subroots
            UNION ALL SELECT height + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY height, pos // 8, n
        ), runs AS (
            SELECT lang, height, pos // 8 AS run, list(digest ORDER BY pos) AS members FROM trees WHERE n > 1 GROUP BY ALL
        ), top_runs AS (
            SELECT height, pos // 8 AS run, list(digest ORDER BY pos) AS members FROM tops WHERE n > 1 GROUP BY ALL
        ), walk(doc_id, lang, leaf, height, pos, n, folded, beside) AS (
            SELECT doc_id, lang, leaf, 0, pos, n, coalesce(changed, leaf), '' FROM entries
            UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.height + 1, w.pos // 8, (w.n + 7) // 8,
                sha256(concat(array_to_string(r.members[:w.pos % 8], ''), w.folded, array_to_string(r.members[w.pos % 8 + 2:], ''))),
                concat(w.beside, array_to_string(r.members[:w.pos % 8], ''), array_to_string(r.members[w.pos % 8 + 2:], ''))
            FROM walk w JOIN runs r ON w.lang IS NOT DISTINCT FROM r.lang AND w.height = r.height AND w.pos // 8 = r.run WHERE w.n > 1
        ), over(doc_id, leaf, subroot, height, pos, n, folded, beside) AS (
            SELECT w.doc_id, w.leaf, s.digest, 0, s.pos, s.n, w.folded, w.beside FROM walk w JOIN subroots s ON w.n = 1 AND w.lang IS NOT DISTINCT FROM s.lang
            UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.height + 1, w.pos // 8, (w.n + 7) // 8,
                sha256(concat(array_to_string(r.members[:w.pos % 8], ''), w.folded, array_to_string(r.members[w.pos % 8 + 2:], ''))),
                concat(w.beside, array_to_string(r.members[:w.pos % 8], ''), array_to_string(r.members[w.pos % 8 + 2:], ''))
            FROM over w JOIN top_runs r ON w.height = r.height AND w.pos // 8 = r.run WHERE w.n > 1
        )
        SELECT doc_id, leaf, subroot, t.digest AS root, sha256(beside) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
        FROM over JOIN tops t ON over.n = 1 AND t.n = 1
""",
}
