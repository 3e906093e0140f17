"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm import (
    byte_bpe,
    conversation_trie,
    decontamination,
    exact_dedup,
    fingerprints,
    html_extraction,
    license_scan,
    line_dedup,
    packing,
    simhash,
    substring_dedup,
    tokenizer_alignment,
    toxicity,
)
from labelspark.llm.common import documents

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SIDE_A = public_tokenizers.path("byte_bpe_50k.json")
SIDE_B = public_tokenizers.path("piece_bpe_32k.model")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), WORD_VOCABULARY).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, toxicity.train(docs, labels))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(
        documents(spark, sf_dir), license_scan.known_digests(spark)
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), BYTE_VOCABULARY)


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.report(documents(spark, sf_dir), benchmark)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_trie.trie(conversation_trie.branched(conversation_trie.paths(turns)))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.align(documents(spark, sf_dir), SIDE_A, SIDE_B)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_license_scan, op4_exact_dedup, op5_line_dedup,
        op6_document_fingerprints, op7_simhash_near_dedup, op8_html_extraction,
        op9_substring_dedup, op10_byte_bpe, op11_benchmark_decontamination,
        op12_conversation_trie, op13_tokenizer_alignment,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    lower = f"lower(coalesce({text}, ''))"
    lines = f"regexp_replace({lower}, {_quoted(license_scan.COPYRIGHT_LINE)}, chr(10), 'g')"
    plain = f"regexp_replace({lines}, {_quoted(license_scan.SIGNS)}, ' ', 'g')"
    plain = f"' ' || trim({plain}, ' ') || ' '"
    for other, usual in license_scan.SPELLINGS:
        plain = f"replace({plain}, {_quoted(f' {other} ')}, {_quoted(f' {usual} ')})"
    return plain


# CRC-32 of a conversation's decimal id: bit by bit, since DuckDB has no function for it.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
    string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda z: z::UBIGINT)),
    lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::UBIGINT) ELSE s // 2 END)),
    4294967295::UBIGINT)"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_KNOWN = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in license_scan.KNOWN)

SQL = {
    "op3_license_scan": f"""
        WITH known AS (
            SELECT sha256({_canonical("t")}) AS digest, min(id) AS license_id
            FROM (VALUES {_KNOWN}) AS k(id, t) GROUP BY 1
        ), units AS (
            SELECT doc_id, 0 AS unit, coalesce(text, '') AS said FROM documents
            UNION ALL
            SELECT doc_id, generate_subscripts(lines, 1) AS unit, unnest(lines) AS said
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
        ), found AS (SELECT doc_id, unit, sha256({_canonical("said")}) AS digest FROM units)
        SELECT doc_id, unit, digest, license_id FROM found LEFT JOIN known USING (digest)
        WHERE unit = 0 OR license_id IS NOT NULL
    """,
    "op4_exact_dedup": r"""
        WITH plain AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        ), kept AS (
            SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id
            FROM plain
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM kept
    """,
    "op5_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
        ), keyed AS (
            SELECT doc_id, line, pos,
                   translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), shared AS (
            SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= {line_dedup.MIN_KEY_CHARS}
            GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCUMENTS}
        )
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (last_id IS NOT NULL AND last_id <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                   FILTER (last_id IS NULL OR last_id = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id
    """,
    "op11_benchmark_decontamination": f"""
        WITH items AS (
            SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
        ), docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        sizes AS (
            SELECT item, w, least(len(w), {decontamination.SPAN}) AS size FROM items WHERE len(w) > 0
        ), known AS (
            SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) AS win
            FROM (SELECT item, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM sizes)
        ), asked AS (
            SELECT r, i, size, list_slice(w, i, i + size - 1) AS win
            FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
                  FROM docs, (SELECT DISTINCT size FROM sizes))
        ), hits AS (SELECT r, i, size, item FROM asked JOIN known USING (size, win)),
        places AS (
            SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r
        ), listed AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
            FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
               n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN places USING (r) LEFT JOIN listed USING (r)
    """,
    "op12_conversation_trie": f"""
        WITH turns AS (
            SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                   ORDER BY turn NULLS FIRST) AS p
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), counted AS (SELECT c, p, {_CRC32} % 6 AS h FROM turns),
        rebuilt AS (
            SELECT a.c, list_concat(list_slice(coalesce(b.p, []), 1, h), list_slice(a.p, h + 1, len(a.p))) AS p
            FROM counted a LEFT JOIN turns b ON b.c = a.c - a.c % 100
        ), prefixes AS (
            SELECT c, len(p) AS size, d, list_slice(p, 1, d) AS node
            FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM rebuilt)
        ), nodes AS (
            SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256,
                   (count(*) - 1) * coalesce(length(node[d].t), 0) AS saved
            FROM prefixes GROUP BY node, d
        ), kids AS (
            SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
        ), above AS (
            SELECT list_slice(n.node, 1, u) AS node, n.saved, (k.n IS NULL)::INT AS leaf
            FROM (SELECT node, saved, unnest(range(0, d + 1)) AS u FROM nodes) n LEFT JOIN kids k USING (node)
        ), sums AS (
            SELECT node, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
            FROM above GROUP BY node
        )
        SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs,
               coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums USING (node) LEFT JOIN kids k USING (node)
        LEFT JOIN nodes q ON n.d > 0 AND q.d = n.d - 1 AND q.node = list_slice(n.node, 1, n.d - 1)
    """,
}
