"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, collocations, decontaminate, jaccard_join, langid, line_dedup, lm, prefix_trie, quality, secret_scan, token_counts, token_output, url_filters
from trailmark.llm.common import crc_mod, scratch, table

#: Fixed rules: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.references(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_language(docs, langid.fit_profiles(langid.training_rows(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_output.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_output.read_token_files(spark, path)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return lm.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0, path, public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-counts"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.learn_field(docs))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_quality_rules, op3_decontamination, op4_byte_bpe, op5_language_id, op6_jaccard_join, op7_token_files, op8_lm_scores, op9_line_dedup, op10_token_counts, op11_collocations, op12_prefix_trie, op13_secret_scan)}

ORACLE_SQL = {
    "op12_prefix_trie": """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (
    SELECT conv_id, conv_id - conv_id % 5 AS origin, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT i.conv_id, pos, role, text FROM ids i JOIN turns t ON t.conv_id = i.origin AND pos <= h
    UNION ALL SELECT i.conv_id, pos, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND pos > h
), paths AS (
    SELECT ids.conv_id, coalesce(path, []) AS path FROM ids LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS path FROM rebuilt GROUP BY conv_id) USING (conv_id)
), steps AS (
    SELECT conv_id, d, path[1:d] AS node, d = len(path) AS ends FROM (SELECT *, unnest(generate_series(0, len(path))) AS d FROM paths)
), nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended FROM steps GROUP BY node, d
), children AS (
    SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), whole AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.node[d].text) END AS value FROM nodes n LEFT JOIN children c ON c.node = n.node
), below AS (
    SELECT node[1:j] AS node, sum(value)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(generate_series(0, d)) AS j FROM whole) GROUP BY ALL
)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(w.ended, '')) AS ends_sha256
FROM whole w JOIN below b ON b.node = w.node LEFT JOIN nodes p ON w.d > 0 AND p.d = w.d - 1 AND p.node = w.node[1:w.d - 1]
""",
    "op11_collocations": r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL)
), places AS (
    SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0
), f AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), sizes AS (
    SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), frequent AS (
    SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= 100
), cuts AS (
    SELECT lang, k, phrase, a, w, unnest(generate_series(1, k - 1)) AS cut FROM frequent WHERE k > 1
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN sizes s ON s.lang = c.lang
), worst AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
    SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM frequent WHERE k > 2), (SELECT unnest([2, 3, 4]) AS m) WHERE m < k AND i + m - 1 <= k
), within AS (
    SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL
), ranked AS (
    SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank FROM worst w LEFT JOIN within i ON i.lang = w.lang AND i.phrase = w.phrase WHERE most IS NULL OR 100 * most < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
    "op9_line_dedup": """
WITH docs AS (
    SELECT doc_id, source, text, row_number() OVER () AS r FROM documents
), lines AS (
    SELECT r, doc_id, source, i, line, trim(line, ' ') AS key, len(regexp_split_to_array(trim(line, ' '), ' +')) >= 6 AS long_line
    FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
), spread AS (
    SELECT key, min(doc_id) AS first_id FROM lines WHERE long_line GROUP BY key HAVING count(DISTINCT source) >= 5
), kept AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS text
    FROM (SELECT r, i, line, long_line AND spread.key IS NOT NULL AND doc_id IS DISTINCT FROM first_id AS cut FROM lines LEFT JOIN spread ON lines.key = spread.key)
    GROUP BY r
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept.text) AS text_sha256 FROM docs LEFT JOIN kept USING (r)
""",
    "op1_url_filters": """
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
    SELECT page_id, host, path, (SELECT max_by(rule_host || rule_path || ' ' || rule_verdict, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS hit FROM part
)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, coalesce(split_part(hit, ' ', 2), 'allow') AS verdict FROM judged
""",
}
