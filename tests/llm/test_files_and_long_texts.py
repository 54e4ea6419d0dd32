"""Index files that skip what a filter can't want, and long texts in the operators that read whole ones."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import bpe, decontaminate, line_dedup, token_counts, token_output, url_filters
from trailmark.llm.common import scratch


def rows_scanned(spark, df):
    """Rows that a frame's scans gave to Spark."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, total = plan.toString(), 0
    leaves = plan.executedPlan().collectLeaves() if "AdaptiveSparkPlan" in text else plan.collectLeaves()
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


def test_stripes_and_row_groups_are_skipped(spark):
    """Of 60,000 documents, a look for two reads some row groups, not the files."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    token_output.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), out := scratch(spark, "test"))
    whole = spark.read.orc(out).select("doc_id", "ids")
    assert rows_scanned(spark, whole) == 60_000
    some = token_output.read_documents(spark, out, [31, 45_000])
    assert {r.doc_id for r in some.collect()} == {31, 45_000}
    assert "PushedFilters: [In(doc_id, [31,45000])]" in some._jdf.queryExecution().executedPlan().toString()
    assert rows_scanned(spark, some) <= 25_000  # row groups of ten thousand rows
    assert rows_scanned(spark, token_output.read_documents(spark, out, [70_000])) == 0


LONG = " ".join(f"word{k % 3000}" for k in range(150_000))


def test_long_texts_everywhere(spark):
    """A text of over a million characters beside small ones, for the operators that no other test gives one."""
    lines = "\n".join(f"this is line number {k} of a long text" for k in range(30_000))
    docs = spark.createDataFrame([(1, LONG, "en", "a", 0), (2, "a short one", "en", "b", 0), (3, lines, "en", "c", 0)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import base64

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}, special_tokens={})
    for r in bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect():
        text = {1: LONG, 2: "a short one", 3: lines}[r.doc_id]
        ids = plain.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    token_output.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), out := scratch(spark, "test"))
    assert token_output.read_token_files(spark, out).where("n_tokens > 100000").count() == 2
    counted = {r.doc_id: (r.n_bytes, r.over_limit) for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "cache")).collect()}
    assert counted == {1: (len(LONG), True), 2: (11, False), 3: (len(lines), True)}
    kept = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {1: (1, 0), 2: (1, 0), 3: (30_000, 0)}
    item = "a benchmark item of many rare words like quixotic zephyr marmalade obelisk and juniper whose answer is forty two"
    leaking = docs.union(spark.createDataFrame([(4, LONG + " " + item + " " + LONG, "en", "d", 0)], docs.schema))
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(leaking, benchmark).select("doc_id").collect()} == {4}


def test_long_urls_and_rules_of_one_length(spark):
    """A path of a million characters; of equally long rules for one place, extra columns whose names clash."""
    rules = spark.createDataFrame([("org", "/ab", "block"), ("b.org", "/", "allow"), ("org", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.org/ab" + "c" * 1_000_000, "h", "v"), (2, "http://b.org/zz", None, "v"), (3, None, "h", None)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).select("page_id", "rule", "verdict").collect()}
    assert got == {1: ("org/ab", "block"), 2: ("b.org/", "allow"), 3: (None, "allow")}


def test_pipeline_of_empty_null_and_repeated_rows(spark, tmp_path):
    """An empty table gives no rows; null ids and texts and repeated rows pass a whole run."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    benchmark = spark.createDataFrame([(1, "nothing that any text has at all in this small world of ours")], "item_id long, text string")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 30").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    odd = real.union(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0)], schema)).union(real.where("doc_id < 3")).union(real.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    for name, docs in (("none", real.limit(0)), ("odd", odd)):
        benchmark.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    found = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert len(found) > 10 and len(ids) == len(set(ids)) and len(found) <= real.select("text").distinct().count()
