"""Registered queries of the subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.ann import nearest
from ledgerlens.llm.collocations import collocations
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.html_extract import extract_text
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.near_dup import near_duplicates
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.pii import pii_digest, pii_spans
from ledgerlens.llm.prefix_trie import conversation_trie
from ledgerlens.llm.quality import quality_decisions
from ledgerlens.llm.secret_scan import scan_secrets
from ledgerlens.llm.substring_dedup import substring_dedup
from ledgerlens.llm.token_counts import token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_decisions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "quality.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(pii_spans(_documents(spark, sf_dir)))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_documents(spark, sf_dir))
    return found.select("doc_id", "start", "end", "score", F.sha2("value", 256).alias("value_sha256"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_quality, op3_exact_dedup, op4_source_mix, op5_pii, op6_near_duplicates, op7_token_counts,
        op8_packing, op9_nearest, op10_secrets, op11_html_text, op12_collocations, op13_prefix_trie)
}

SQL: dict[str, str] = {
    "op1_substring_dedup": """
        WITH texts AS (
            SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
        placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts),
        windows AS (
            SELECT doc_id, place, string_agg(word, ' ') OVER w AS run, COUNT(*) OVER w AS n
            FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        first_holders AS (SELECT run, MIN(doc_id) AS holder FROM windows WHERE n = 50 GROUP BY run),
        gone AS (
            SELECT DISTINCT doc_id, place + step AS place
            FROM windows JOIN first_holders USING (run), range(50) AS steps(step)
            WHERE n = 50 AND holder < doc_id),
        stays AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, COUNT(*) AS n_kept
            FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, len(words) - COALESCE(n_kept, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
        FROM texts LEFT JOIN stays USING (doc_id)
    """,
    "op3_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, COALESCE(text, '') AS text,
                   sha256(regexp_replace(COALESCE(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               FIRST_VALUE(doc_id) OVER w AS keep_id,
               COUNT(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = FIRST_VALUE(doc_id) OVER w AS kept,
               text_sha256
        FROM normal
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY LENGTH(text) DESC, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    "op12_collocations": """
        WITH pieces AS (
            SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
        totals AS (SELECT lang, SUM(len(words)) AS n FROM worded GROUP BY lang HAVING SUM(len(words)) > 0),
        grams AS (
            SELECT lang, size, array_to_string(words[spot : spot + size - 1], ' ') AS gram, COUNT(*) AS f
            FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS spot
                  FROM worded, range(1, 6) AS sizes(size)) GROUP BY ALL HAVING COUNT(*) >= 100),
        candidates AS (SELECT lang, size, gram AS phrase, string_split(gram, ' ') AS words, f AS a FROM grams WHERE size > 1),
        inside AS (
            SELECT DISTINCT lang, array_to_string(words[spot : spot + part - 1], ' ') AS phrase, a AS held
            FROM (SELECT *, unnest(range(1, size - part + 2)) AS spot
                  FROM (SELECT *, unnest(range(2, size)) AS part FROM candidates))),
        staying AS (
            SELECT * FROM candidates c
            WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * held >= 100 * a)),
        cuts AS (
            SELECT c.lang, phrase, a, cut, h.f AS l, t.f AS r, CAST(totals.n AS BIGINT) AS n,
                   CAST((1000::HUGEINT * a * totals.n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, size)) AS cut FROM staying) c
            JOIN grams h ON h.lang = c.lang AND h.gram = array_to_string(c.words[1 : cut], ' ')
            JOIN grams t ON t.lang = c.lang AND t.gram = array_to_string(c.words[cut + 1 : c.size], ' ')
            JOIN totals ON totals.lang = c.lang),
        best AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM best QUALIFY rank <= 2000
    """,
    "op13_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
                   ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(LENGTH(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, ''))) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        -- CRC-32 bit by bit: a byte is mixed in, then eight shifts (written as -1).
        sums AS (
            SELECT conv_id, xor(4294967295, list_reduce(
                [4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END)) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)),
        parts AS (
            SELECT s.conv_id, 0 AS own, place, role, text
            FROM sums s JOIN turns t ON t.conv_id = s.conv_id - s.conv_id % 100 AND place <= h
            UNION ALL
            SELECT conv_id, 1, place, role, text FROM turns JOIN sums USING (conv_id) WHERE place > h),
        built AS (
            SELECT conv_id, LIST({'role': role, 'text': text} ORDER BY own, place) AS told FROM parts GROUP BY conv_id
            UNION ALL
            SELECT conv_id, [] FROM sums WHERE conv_id NOT IN (SELECT conv_id FROM parts)),
        paths AS (SELECT conv_id, told, len(told) AS size, unnest(range(len(told) + 1)) AS depth FROM built),
        prefixes AS (SELECT conv_id, size, depth, told[1:depth] AS prefix FROM paths),
        nodes AS (
            SELECT prefix, depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
                   sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
            FROM prefixes GROUP BY prefix, depth),
        kin AS (
            SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id
            FROM nodes c JOIN nodes p ON c.depth = p.depth + 1 AND c.prefix[1:p.depth] = p.prefix),
        families AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, COUNT(*) AS n FROM kin GROUP BY ALL),
        own AS (
            SELECT n.*, COALESCE(f.n, 0) AS n_children, (n_convs - 1) * LENGTH(COALESCE(prefix[depth].text, '')) AS saved
            FROM nodes n LEFT JOIN families f USING (conv_id, depth)),
        totals AS (
            SELECT p.prefix, p.depth, COUNT(*) FILTER (WHERE n_children = 0) AS n_leaves, SUM(saved) AS saved_tokens
            FROM own o JOIN prefixes p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY ALL)
        SELECT o.conv_id, o.depth, parent_conv_id, n_convs, n_children, n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM own o JOIN totals t ON o.depth = t.depth AND o.prefix = t.prefix
        LEFT JOIN kin k ON k.conv_id = o.conv_id AND k.depth = o.depth
    """,
}
