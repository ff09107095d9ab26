"""The operators on whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelens.llm import (
    bloom_lm,
    byte_bpe,
    fit_packing,
    hash_tree,
    language,
    periodic_runs,
    permutation_index,
    prefix_trie,
    quality,
    shingle_join,
    suffix_dedup,
    tier_packing,
    weighted_fingerprints,
)
from pricelens.llm.tables import read


def op1_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.packed(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(read(spark, sf_dir, "embeddings"))


def op5_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_packing.matrices(read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(read(spark, sf_dir, "documents"))


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scored(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked_documents(read(spark, sf_dir, "documents"))


def op10_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints.compared_with_edits(read(spark, sf_dir, "documents"))


def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shards_and_growth(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_nodes(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tier_packing": op1_tier_packing,
    "op2_quality": op2_quality,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_permutation_index": op4_permutation_index,
    "op5_fit_packing": op5_fit_packing,
    "op6_language": op6_language,
    "op7_bloom_lm": op7_bloom_lm,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_shingle_join": op9_shingle_join,
    "op10_weighted_fingerprints": op10_weighted_fingerprints,
    "op11_hash_tree": op11_hash_tree,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

#: crc32 of the decimal conv_id, bit by bit; -1 stands for a shift.
_CRC32 = """
xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END))
"""

#: The others have no plain SQL form; tests/llm compares each with a brute-force version.
ORACLES: dict[str, str] = {
    "op13_prefix_trie": f"""
    WITH own AS (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                             ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
               {_CRC32} % 9 AS h
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
        FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
    ), prefixes AS (
        SELECT conv_id, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
    ), paths AS (
        SELECT conv_id, n, depth, strlen(turns[depth].text) AS bytes,
               min(conv_id) OVER (PARTITION BY depth, turns[1:depth]) AS node
        FROM prefixes
    ), nodes AS (
        SELECT node, depth, count(*) AS n_convs, any_value(bytes) AS bytes, max(n) = depth AS childless,
               coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
        FROM paths GROUP BY node, depth
    ), below AS (
        SELECT p.node, p.depth, count(*) FILTER (v.depth = p.depth + 1) AS n_children,
               count(*) FILTER (v.childless) AS n_leaves,
               sum(CASE WHEN v.depth > 0 THEN (v.n_convs - 1) * v.bytes ELSE 0 END)::BIGINT AS saved_tokens
        FROM nodes v JOIN paths p ON p.conv_id = v.node AND p.depth <= v.depth
        GROUP BY p.node, p.depth
    )
    SELECT n.node AS conv_id, n.depth, up.node AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves,
           b.saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN below b USING (node, depth)
    LEFT JOIN paths up ON up.conv_id = n.node AND up.depth = n.depth - 1
    """,
}
