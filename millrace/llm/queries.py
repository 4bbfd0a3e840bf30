"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    byte_bpe,
    decontaminate,
    language_id,
    lexical_search,
    line_dedup,
    ppm,
    prefix_trie,
    quality_classifier,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    token_files,
)
from millrace.llm._scratch import written
from millrace.sources import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.find_items(docs, items).drop("doc")


OP1_SQL = r"""
WITH words AS (
    SELECT FALSE AS is_item, doc_id AS id, text FROM documents
    UNION ALL SELECT TRUE, item_id, text FROM benchmark
), cut AS (
    SELECT is_item, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM words
), widths AS (
    SELECT DISTINCT least(len(w), 5) AS k FROM cut WHERE is_item AND len(w) > 0
), spread AS (
    SELECT is_item, id, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM cut JOIN widths ON len(w) >= k AND (NOT is_item OR k = least(len(w), 5))
), shingles AS (
    SELECT DISTINCT is_item, id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM spread
), items AS (
    SELECT id AS item_id, k, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE is_item
)
SELECT d.id AS doc_id, item_id, count(*) AS n_shared, n AS n_shingles
FROM shingles d JOIN items USING (k, s)
WHERE NOT d.is_item
GROUP BY d.id, item_id, n
HAVING 10 * count(*) >= 8 * n
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs = (read_table(spark, sf_dir, t) for t in ("pages", "documents"))
    return language_id.identify(pages, docs)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    fingerprint = simhash.hexadecimal(F.col("fp")).alias("fingerprint")
    return found.select("doc_id", fingerprint, "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = (
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, path, pattern)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    stored = written(token_files.segments(docs, path, end_id=2), "token-files")
    return token_files.documents_of(stored)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _letters() -> Column:
    return F.length(F.regexp_replace("text", "[^\\p{L}]+", ""))


def document_rules() -> list[quality_rules.Rule]:
    """Rules over ``text``, each with the measures that it needs."""
    m = quality_rules.text_measures()
    n, chars, lines = m["n_words"], m["word_chars"], m["n_lines"]
    return [
        quality_rules.Rule("few words", n < 50),
        quality_rules.Rule("repeats itself", 100 * m["n_repeat_words"] > 50 * n),
        quality_rules.Rule("symbols", 10 * m["n_symbols"] > n),
        quality_rules.Rule("equal lines", (lines >= 5) & (2 * m["n_dup_lines"] > lines)),
        quality_rules.Rule("short words", chars < 2 * n),
        quality_rules.Rule("long words", chars > 20 * n),
        quality_rules.Rule("few letters", 2 * _letters() < chars),
    ]


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.cascade(docs, document_rules(), quality_rules.draw(docs))
    # The measures that the result shows are worked out for every row, beside the cascade.
    n = F.col("n_words")
    base_failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return quality_rules.measures(judged).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        "kept",
    )


OP7_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM cut WHERE len(w) >= 3)
), again AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT j) AS n
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id
), measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(l) AS BIGINT) AS n_lines,
           CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
    FROM cut LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 10 * n_symbols > n_words OR (n_lines >= 5 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * letters < word_chars) AS kept
FROM measured
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = substring_dedup.remove_repeats(docs)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return ppm.score_texts(docs, training=F.coalesce(~held_out, F.lit(True)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    judged = quality_classifier.classify(docs, labels)
    return judged.select("doc_id", "evidence", "p_bad", "keep")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.drop_shared_lines(docs, min_docs=10, min_chars=1)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), lines AS (
    SELECT r, i, lines[i] AS line, translate(
        regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
), shared AS (
    SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), kept AS (
    SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE s.key IS NULL) AS text,
           count(s.key) AS n_dropped
    FROM lines LEFT JOIN shared s USING (key) GROUP BY r
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, n_dropped,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs JOIN kept USING (r)
"""


def rebuilt(turns: DataFrame) -> DataFrame:
    """Numbered turns, each conversation ``c`` begun anew with the first ``crc32(c) % 9`` turns of
    conversation ``c - c % 5`` in place of as many of its own."""
    n = F.crc32(F.col("conv_id").cast("string")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = turns.select("conv_id").distinct().select("conv_id", n.alias("h"), base.alias("base"))
    first = turns.where((F.col("conv_id") % 5 == 0) & (F.col("position") < 8)).groupBy("conv_id")
    first = first.agg(F.sort_array(F.collect_list(F.struct("position", "one", "two"))).alias("turns"))
    convs = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    began = F.slice(F.coalesce("turns", F.array().cast("array<struct<position:long,one:long,two:long>>")), 1, F.col("h").cast("int"))
    convs = convs.select("conv_id", "h", began.alias("began"))
    head = convs.select("conv_id", F.inline("began"))
    rest = turns.join(convs.select("conv_id", "h", F.size("began").alias("n")), "conv_id").where("position >= h")
    rest = rest.select("conv_id", (F.col("position") - F.col("h") + F.col("n")).alias("position"), "one", "two")
    return head.union(rest)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return prefix_trie.prefixes(rebuilt(prefix_trie.numbered(turns)), turns)


OP12_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_concat([4294967295], flatten(
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                       lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END),
        4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), built AS (
    SELECT c.conv_id, 0 AS own, i, role, text FROM convs c JOIN turns t ON t.conv_id = base AND i <= h
    UNION ALL SELECT c.conv_id, 1, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i > h
), paths AS (
    SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY own, i)
                             FILTER (WHERE text IS NOT NULL), []) AS path
    FROM convs LEFT JOIN built USING (conv_id) GROUP BY conv_id
), members AS (
    SELECT conv_id, path[1:d] AS node, d, len(path) AS n
    FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM paths)
), nodes AS (
    SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           max(n) = d AS leaf, CASE WHEN d > 0 THEN (count(*) - 1) * strlen(node[-1].text) ELSE 0 END AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
    FROM members GROUP BY node, d
), above AS (
    SELECT node[1:k] AS top, k, depth, leaf, saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes)
), sums AS (
    SELECT top, CAST(sum(CAST(depth = k + 1 AS BIGINT)) AS BIGINT) AS n_children,
           CAST(sum(CAST(leaf AS BIGINT)) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
    FROM above GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON top = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return lexical_search.best_documents(docs, items, k=10)


OP13_SQL = r"""
WITH cut AS (
    SELECT FALSE AS is_item, row_number() OVER () AS r, doc_id AS id, text FROM documents
    UNION ALL SELECT TRUE, row_number() OVER (), item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), terms AS (
    SELECT is_item, r, id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM cut
), postings AS (
    SELECT r, id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY r) AS n
    FROM terms WHERE NOT is_item GROUP BY r, id, term
), everything AS (
    SELECT count(DISTINCT r) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_terms FROM postings
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, everything GROUP BY term, n_docs
), scored AS (
    SELECT i.r, i.id AS item_id, p.r AS doc, p.id AS doc_id, CAST(sum(w * ((1000000000 * tf) //
               (1000 * tf + 8 * (10 + (CAST(90 * n AS BIGINT) * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM (SELECT DISTINCT r, id, term FROM terms WHERE is_item) i
    JOIN postings p USING (term) JOIN weights USING (term), everything
    GROUP BY i.r, i.id, p.r, p.id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ppm": op9_ppm,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {
    "op1_decontamination": OP1_SQL,
    "op7_quality_rules": OP7_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
