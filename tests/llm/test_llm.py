import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import bpe, decontaminate, jaccard_join, langid, line_dedup, lm, quality, token_counts, token_output, url_filters
from trailmark.llm.common import scratch, shared_dir

SF = "/root/testdata/sf0.001"
ODD = [None, "", "a", "  a  b ", "a\n  b\n ", "x" * 3000, "word " * 5000, "日本語 ² ½ a²", "<|endoftext|> hi", "don't we'll", "a \n", "a\n ", "é́x ﬁ", "a▁b", "Ünder großer Straße"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, margin string, hashes string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    rows = [(i if i % 5 else None, t, "en" if i % 2 else None, None if i % 3 else "s", None, "m", "h") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:6], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [r.text or "" for r in df.collect()]


def test_byte_bpe(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((len(i := own.encode_ordinary(t)), sha(" ".join(map(str, i)).encode()), sha(t.encode())) for t in texts(docs))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()) == want
    assert bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    out = scratch(spark, "test")
    token_output.write_token_files(docs, path, out)
    found = token_output.read_token_files(spark, out).orderBy("start").collect()
    assert sorted(r.n_tokens for r in found) == sorted(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts(docs))
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    assert [r.doc_id or -1 for r in found] == sorted(r.doc_id or -1 for r in found)
    token_output.write_token_files(none, path, empty := scratch(spark, "test"))
    assert token_output.read_token_files(spark, empty).count() == 0


def test_token_counts(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = scratch(spark, "cache")
    want = sorted((len(t.encode()), len(library.encode(t))) for t in texts(odd))
    for _ in range(2):  # the second time from the cache
        assert sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, path, cache).collect()) == want
    assert token_counts.count_tokens(none, path, cache).count() == 0
    assert spark.read.parquet(cache).count() == len(set(texts(odd)))


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.fit_profiles(langid.training_rows(docs))
    found = langid.predict_language(docs, profiles).join(docs, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    judged = langid.with_language(odd, profiles)
    assert judged.where("text is null or text = ''").select("language.lang_pred").distinct().collect() == [("und",)]
    assert judged.count() == odd.count()
    assert langid.with_language(none, {}).count() == 0 and langid.fit_profiles(none) == {}


def brute_links(rows):
    def shingles(t):
        w = t.lower().encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    return {i: sum(1 for k, (j, b) in enumerate(sets) if k != n and a and b and 5 * len(a & b) >= 4 * len(a | b)) for n, (i, a) in enumerate(sets)}


def test_jaccard_join(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    want = brute_links([(r.doc_id, r.text or "") for r in docs.collect()])
    assert {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(docs).collect()} == want
    assert jaccard_join.near_duplicates(odd).count() == odd.count()
    assert jaccard_join.keep_one(odd).columns == odd.columns
    assert jaccard_join.near_duplicates(none).count() == 0


def test_decontamination(spark, odd, none):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    held = docs.crossJoin(items.withColumnRenamed("text", "item")).where("contains(text, item)").select("doc_id", "item_id").collect()
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert len(found & {tuple(r) for r in held}) >= 0.95 * len(held)
    assert decontaminate.find_leaks(odd, items).count() == 0
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.drop_leaks(odd, items.limit(0)).count() == odd.count()


def test_decontamination_of_a_frequent_item(spark):
    item = "Quartz lanterns guide the weary ferrymen past seven drowned mills. Their keeper counts every oar before dusk."
    rows = [(i, " ".join(f"w{(i * 37 + 11 * k) % 5000}" for k in range(120)) + (f" {item} tail{i}" if i % 3 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, " ".join(f"w{k}" for k in range(4000, 4020)))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {i for i, k in found if k == 1} == {i for i in range(900) if i % 3 == 0}


def test_decontamination_of_paraphrases(spark):
    one = [f"a{k}" for k in range(30)]
    many = ["First", "comes", "little.", *(f"b{k}" for k in range(24))]
    items = spark.createDataFrame([(1, " ".join(one) + "."), (2, " ".join(many) + ".")], "item_id long, text string")

    def reworded(words, last):  # every third word replaced, but for the last ones
        return " ".join(w if k % 3 or k >= len(words) - last else f"other{k}" for k, w in enumerate(words))

    rows = [(i, f"x{i} y{i} " + reworded(w, last) + f" z{i}") for i, (w, last) in enumerate([(one, 8), (many, 8), (one, 0), (many, 0)])]
    # Texts with a few of the words each, in no order, span the latent space.
    rows += [(i, " ".join(random.Random(i).sample(one + many, 6))) for i in range(10, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Reworded items count with their last words only.
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} == {(0, 1), (1, 2)}


def test_groups_and_leaks_of_null_and_repeated_ids(spark):
    a, b, clean, item = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (None, a + " z"), (None, b), (None, b + " z"), (7, clean), (7, clean + " z"), (7, item), (8, item + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in jaccard_join.keep_one(docs).collect()) == [(0, "a0"), (0, "b0"), (7, "c0"), (7, "d0")]
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame([(1, item), (2, a)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == sorted([b, b + " z", clean, clean + " z"])


def test_line_dedup(spark, odd, none):
    line = "one two three four five six seven"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    cut = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert cut[0] == (f"{line}\nown 0", 0) and cut[5] == ("own 5", 1)
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_stage_leaves_copies_to_the_next_one(spark):
    notice = "This page is published under the free license of its authors."
    lines = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(10)]
    whole = "\n".join([*lines, "end."])
    # Copies over six sites, with a notice that the original lacks; near copies with one line edited; own texts with it.
    rows = [(0, f"{notice}\nfirst of all, with many more words of its own in this line than the notice above has in its line"), (1, whole), *((i, f"{notice}\n{whole}") for i in range(2, 7)),
            *((i, "\n".join([*lines[:9], f"edited {i} {lines[9]}", "end."])) for i in range(7, 12)), *((i, f"{notice}\nown words of document {i} that no other one has") for i in range(12, 18))]
    docs = spark.createDataFrame([(i, t, f"s{i % 6}", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    cut = corpus_pipeline.line_dedup_stage(spark, docs, SF)
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, cut, SF).collect()}
    assert sorted(kept) == [0, 1, *range(12, 18)]
    assert kept[1] == whole and all(notice not in kept[i] for i in range(12, 18))


def test_quality(spark, odd, none):
    assert quality.judge_quality(odd, {}).where("n_words < 50 and kept").count() == 0
    words = "a b c d a b c x"
    row = quality.judge_quality(spark.createDataFrame([(1, words, "en")], "doc_id long, text string, lang string"), {}).first()
    assert (row.n_words, row.word_chars, row.n_repeat_words) == (8, 8, 6)
    assert quality.judge_quality(none, quality.references(none)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.org/x?q"), (1, None), (2, "no scheme"), (2, "http://b.example.org/en/15"), (3, "http://com/de/"), (3, "http://com/de/"), (4, "ftp://notorg/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")], "host string, path string, verdict string")
    found = sorted((r.page_id, r.host, r.rule or "", r.verdict) for r in url_filters.judge_urls(pages, rules).collect())
    assert found == [(1, "", "", "allow"), (1, "a.org", "org/", "allow"), (2, "", "", "allow"), (2, "b.example.org", "example.org/en/1", "block"), (3, "com", "com/de/", "block"), (3, "com", "com/de/", "block"), (4, "notorg", "", "allow")]
    assert url_filters.judge_urls(pages, rules.limit(0)).count() == len(rows) and url_filters.judge_urls(pages.limit(0), rules).count() == 0


def test_lm(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = odd.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), None]
    rows = [(r.doc_id, tokens(r.text or "")) for r in docs.collect()]
    counts = Counter(w for i, ws in rows if i % 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(ws), sum(w in counts for w in ws), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for _, ws in rows)
    found = lm.score_texts(docs, F.col("doc_id") % 2 == 0, path, public_tokenizers.PATTERN).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)


def test_lm_does_not_depend_on_the_layout(spark, monkeypatch):
    """Shards, sums of weights and counts give the same scores however rows are dealt."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(i, " ".join(random.Random(i).choices(["one", "two", "three", "four"] if i % 2 else ["eins", "zwei", "drei"], k=80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("SHARE", 2), ("SHARD", 3_000), ("ADDENDS", 3)):
        monkeypatch.setattr(lm, name, value)
    scores = [{r.doc_id: r.score for r in lm.score_texts(docs.repartition(n), F.col("doc_id") % 10 == 0, path, public_tokenizers.PATTERN).collect()} for n in (1, 5)]
    assert scores[0] == scores[1] and len(scores[0]) == 60


def test_lm_segments_go_on_where_the_last_one_ended():
    model = small_model()
    random_ = np.random.default_rng(4)
    ids, given = random_.integers(1, model.columns, 96).astype(np.int32), random_.random((96, lm.TOPICS)).astype(np.float32)
    whole = model.score(lm.Windows(ids, given, np.array([96])), 1)[0]
    parts = [model.score(lm.Windows(ids[a:b], given[a:b], np.array([b - a]), ids[:a]), 1)[0] for a, b in ((0, 48), (48, 96))]
    assert abs(whole - sum(parts)) < 1e-3
    both = model.score(lm.Windows(np.concatenate([ids[:20], ids]), np.concatenate([given[:20], given]), np.array([20, 116])), 2)
    assert abs(both[1] - whole) < 1e-3


def small_model():
    random_ = np.random.default_rng(1)
    context_of = np.full(50, lm.CONTEXTS + 1)
    context_of[:5] = np.arange(1, 6)
    topic, context, token = random_.integers(0, lm.TOPICS, 400), random_.integers(0, 6, 400), random_.integers(0, 40, 400)
    return lm.Model(topic, context, token, random_.integers(1, 9, 400), context_of)


def test_lm_chances_add_up_and_attention_is_causal():
    model = small_model()
    weight = np.ones(model.columns)  # the last column stands for all ids that were never seen
    weight[0], weight[-1] = 0, 50 - (model.columns - 2)
    every = np.arange(model.columns, dtype=np.int32)
    for before in (None, 3, 30):
        columns = every if before is None else np.stack([np.full(len(every), before, np.int32), every], axis=1).ravel()
        given = model.given(columns, np.full(len(every), 1 if before is None else 2))[(0 if before is None else 1) :: (1 if before is None else 2)]
        assert np.allclose(weight @ given, 1, atol=1e-4)
    random_ = np.random.default_rng(2)
    ids, given = random_.integers(1, model.columns, 70).astype(np.int32), random_.random((70, lm.TOPICS)).astype(np.float32)
    w, want = model.gate.w, 0.0
    padded = np.concatenate([np.zeros(lm.CONTEXT, np.int32), ids])
    for n in range(70):  # place by place, each from the window that scores it
        first = n // lm.STRIDE * lm.STRIDE - (lm.CONTEXT - lm.STRIDE + 1)
        seen = padded[first + lm.CONTEXT : n + lm.CONTEXT]
        x = w["embed"][seen] + w["place"][: len(seen)]
        a = np.exp((x[-1] @ w["query"]) @ (x @ w["key"]).T / np.sqrt(lm.WIDTH))
        logits = (a / a.sum() @ (x @ w["value"]) + x[-1]) @ w["out"] + w["bias"]
        weights = np.exp(logits - logits.max())
        want += np.log10((weights / weights.sum()) @ given[n])
    assert abs(model.score(lm.Windows(ids, given, np.array([70])), 1)[0] - want) < 1e-3


def test_lm_attention_is_counted_over_every_training_text(spark):
    """A language that only a few of many texts have, whatever their hashes, is told apart; and passes see every window."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(i, " ".join(random.Random(i).choices(["one", "two", "three", "four"] if i % 40 else ["eins", "zwei", "drei"], k=80))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, model = lm.fit_model(docs.select("text"), path, public_tokenizers.PATTERN)
    ids = [model.column_of[lm.subwords([w], path, public_tokenizers.PATTERN)[0]] for w in (b"three", b"zwei")]
    said = [model.gate.w["embed"][i, : lm.TOPICS] for i in ids]
    assert np.abs(said[0]).max() > 0.5 and np.abs(said[1]).max() > 0.5
    assert model.counts.sum() == sum(len(lm.subwords([*lm.words_of(t), lm.END], path, public_tokenizers.PATTERN)[0]) for _, t in rows)
    assert lm.SHARE == 1
    scores = [sum(r.score for r in lm.score_texts(docs, F.lit(False), path, public_tokenizers.PATTERN, passes=n).collect()) for n in (0, 1)]
    assert scores[1] > 1.2 * scores[0]


def test_lm_gradient_is_the_slope():
    model = small_model()
    random_ = np.random.default_rng(3)
    ids, given = random_.integers(1, model.columns, 64).astype(np.int32), random_.random((64, lm.TOPICS)).astype(np.float32)
    made = lm.Windows(ids, given, np.array([64]))
    window, chances, scored = made.ids(slice(None)), made.given, made.scored()
    gate = model.gate
    gate.w = {k: v.astype(np.float64) for k, v in gate.w.items()}
    _, slopes = gate.gradient(window, chances, scored)
    for name in gate.w:
        place = tuple(random_.integers(0, n) for n in gate.w[name].shape) if name != "embed" else (int(ids[5]), 2)
        moved = []
        for step in (1e-5, -1e-5):
            gate.w[name][place] += step
            moved.append(gate.gradient(window, chances, scored)[0])
            gate.w[name][place] -= step
        assert abs((moved[0] - moved[1]) / 2e-5 - slopes[name][place]) < 1e-4


def test_lm_beats_its_base_on_held_out_texts(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, path, public_tokenizers.PATTERN)
    mean = found.where("held_out").agg(F.avg("score").alias("score"), F.avg("base_score").alias("base")).first()
    assert mean.score > mean.base


def test_jaccard_join_of_all_pairs(spark, monkeypatch):
    """All 1,000 documents against all pairs, with blocks of three sets: links, copies and classes, none missing."""
    monkeypatch.setattr(jaccard_join, "SETS", 3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: frozenset(jaccard_join.shingles(r.text or "").tolist()) for r in docs.collect()}
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        common.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    links, group = Counter(), {i: i for i in sets}
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            old, new = max(group[a], group[b]), min(group[a], group[b])
            if old != new:
                group = {i: new if g == old else g for i, g in group.items()}
    copies = Counter(sets.values())
    found = {r.doc_id: (r.n_links, r.class_id, r.n_copies) for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == {i: (links[i], group[i], copies[s] if s else 1) for i, s in sets.items()}


def test_trie_links_do_not_depend_on_tasks(spark):
    """Prefix links connect exactly the sets that share a prefix in some tree, however the entries are dealt."""
    random_ = np.random.default_rng(0)
    rows = []
    for k in range(60):
        values = np.random.default_rng(k // 6).integers(0, 2**32, jaccard_join.TREES * jaccard_join.DEPTH, np.uint32)
        change = random_.random(len(values)) < 0.1
        rows.append((bytes([k]) * 16, bytearray(np.where(change, random_.integers(0, 2**32, len(values), np.uint32), values).astype(">u4").tobytes())))
    nodes = spark.createDataFrame(rows, "node binary, signature binary")
    parts = np.stack([np.frombuffer(bytes(s), ">u4") for _, s in rows]).reshape(60, jaccard_join.TREES, jaccard_join.DEPTH)
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        links = [(r.a[0], r.b[0], r.depth) for r in jaccard_join.prefix_links(nodes).collect()]
        for depth in range(jaccard_join.LEAST_DEPTH, jaccard_join.DEPTH + 1):
            want, got = ([*range(60)] for _ in range(2))
            pairs = [(a, b) for a in range(60) for b in range(a) if (parts[a, :, :depth] == parts[b, :, :depth]).all(axis=1).any()]
            for label, edges in ((want, pairs), (got, [(a, b) for a, b, d in links if d >= depth])):
                for a, b in edges:
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label[:] = [new if x == old else x for x in label]
            assert want == got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_language_scores_equal_a_plain_bundle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()

    def plain_bundle(text):
        letters = re.sub(r"\\s+", " ", "".join(c if c.isalpha() else " " for c in f" {text} ".lower()))
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            if b != " ":
                va, vb, vc = (langid.letter_vector(0 if x == " " else ord(x)).astype(float) for x in (a, b, c))
                out += np.roll(va, 2) * np.roll(vb, 1) * vc
        return out

    made = {r.doc_id: plain_bundle(r.text or "") for r in rows}
    prototypes = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            prototypes[r.lang] += made[r.doc_id]
    profiles = langid.fit_profiles(langid.training_rows(docs))
    assert {k: v for k, v in profiles.items()} == {k: v.astype(int).tolist() for k, v in sorted(prototypes.items())}
    for r in langid.predict_language(docs, profiles).collect():
        cosines = {k: made[r.doc_id] @ p / max(1e-12, np.linalg.norm(made[r.doc_id]) * np.linalg.norm(p)) for k, p in prototypes.items()}
        best = max(cosines, key=lambda k: round(cosines[k], 9))
        assert (r.lang_pred, round(r.score, 6)) == (best, round(max(0.0, cosines[best]), 6))


def test_quality_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    refs = quality.references(docs)
    found = {r.doc_id: r for r in quality.judge_quality(docs, refs).collect()}
    counts = defaultdict(Counter)
    for r in docs.collect():
        counts[r.lang].update(w.lower().encode().strip(quality.EDGE) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for lang, c in counts.items():
        top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]
        assert (refs[lang]["words"], refs[lang]["counts"], refs[lang]["total"]) == ([w.decode() for w, _ in top], [n for _, n in top], sum(c.values()))

    def distance(p, q):
        p, q = np.array(p, float) / max(1, sum(p)), np.array(q, float) / max(1, sum(q))
        m = (p + q) / 2
        return math.sqrt(max(0.0, sum(x * math.log2(x / y) / 2 for a in (p, q) for x, y in zip(a, m, strict=True) if x > 0)))

    for r in docs.collect():
        text, got = r.text or "", found[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        own = Counter(w.lower().strip(quality.EDGE.decode()) for w in words)
        bins = [own[w] for w in refs[r.lang]["words"]]
        d = distance([*bins, len(words) - sum(bins)], [*refs[r.lang]["counts"], refs[r.lang]["total"] - sum(refs[r.lang]["counts"])])
        assert got.base_failed == failed and abs(got.word_distance - d) < 1e-6
        apart = len(text) >= quality.MIN_CHARS and got.char_distance > quality.MAX_CHAR_DISTANCE or len(words) >= quality.MIN_WORDS and d > quality.MAX_WORD_DISTANCE
        assert got.kept == (not failed and not apart)


def test_token_files_equal_the_library(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = scratch(spark, "test")
    token_output.write_token_files(docs.repartition(5), path, out)
    start, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, token_output.END_ID]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_token_files(spark, out).collect()} == want
    some = {r.doc_id: len(r.ids) for r in token_output.read_documents(spark, out, [3, 77]).collect()}
    assert some == {i: want[i][1] for i in (3, 77)}
    # Another vocabulary's rules aren't known: its texts go to the library whole.
    other = public_tokenizers.path("byte_bpe_50k.json")
    few = docs.where("doc_id < 5")
    token_output.write_token_files(few, other, again := scratch(spark, "test"))
    lengths = {r.doc_id: r.n_tokens - 1 for r in token_output.read_token_files(spark, again).collect()}
    plain_ = tokenizers.Tokenizer.from_file(other)
    assert lengths == {r.doc_id: len(plain_.encode(r.text or "", add_special_tokens=False).ids) for r in few.collect()}


def test_token_limit_and_a_cache_with_repeats(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "one two"), (2, "three " * 50), (3, None)], "doc_id long, text string")
    cache = scratch(spark, "cache")
    first = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path, cache, limit=20).collect()}
    assert [first[i][1] for i in (1, 2, 3)] == [False, True, False]
    spark.read.parquet(cache).write.mode("append").parquet(cache)  # two writers
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path, cache, limit=20).collect()} == first
    assert token_counts.count_tokens(docs, path, cache).count() == 3


def test_patterns_other_than_the_known_one():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = bpe.RankEncoder(path, r".")
    assert encoder.parted("hello") == list("hello")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    assert encoder.chunks(["h", "é"])["é"][0] == " ".join(str(i) for i in tiktoken.Encoding("x", pat_str=r".", mergeable_ranks=ranks, special_tokens={}).encode_ordinary("é"))
    assert encoder.chunks(["z" * 300])["z" * 300][1] == b"z" * 300


def test_exact_items_of_any_length_and_frequency(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    often = items.where("item_id = 0").first().text
    more = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(f"\n{often}\n"))).otherwise(F.col("text")))
    more = more.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" Zyx, wvu!"))).otherwise(F.col("text")))
    named = items.select(F.concat(F.lit("item"), "item_id").alias("item_id"), "text").unionByName(spark.createDataFrame([("short", "zyx wvu"), ("none", "..."), (None, "x")], "item_id string, text string"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(more, named).collect()}
    assert {i for i, k in found if k == "item0"} >= {r.doc_id for r in docs.where("doc_id % 2 = 0").collect()}
    assert {i for i, k in found if k == "short"} == {r.doc_id for r in docs.where("doc_id % 3 = 0").collect()}
    held = docs.crossJoin(items.withColumnRenamed("text", "item")).where("contains(text, item)").select("doc_id", F.concat(F.lit("item"), "item_id")).collect()
    assert {tuple(r) for r in held} <= found
    # Nothing but what holds an item is found: each one is a copy, or nearly so.
    texts_of = {r.doc_id: set(decontaminate.tokens(r.text or "")) for r in more.collect()}
    words_of = {r.item_id: decontaminate.tokens(r.text) for r in named.collect()}
    assert all(sum(w in texts_of[i] for w in words_of[k]) >= decontaminate.MIN_LCS_WITH_ANSWER * len(words_of[k]) for i, k in found)


def test_paraphrases_of_the_benchmark_are_found(spark):
    """Items with a fifth of the words replaced but for the last eight, put into texts without one: recall, and nothing else."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 500").orderBy("doc_id").limit(400).collect()]
    items = [r for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 25][:60]
    random_, rows, want = random.Random(5), [], set()
    for k, text in enumerate(docs):
        if k < len(items):
            words = items[k].text.split()
            words = [w if j >= len(words) - 8 or random_.random() > 0.2 else f"qz{random_.randrange(10**6)}" for j, w in enumerate(words)]
            text = text[:300] + " " + " ".join(words) + " " + text[300:]
            want.add((k, items[k].item_id))
        rows.append((k, text))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items))
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(want & found) >= 0.9 * len(want)
    clean = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame(items)).collect()}
    assert len(found - want - clean) <= 0.02 * len(found)


CLASHING = ["row", "id", "text_key", "_text_key", "cut_lines", "cut", "n_lines", "score", "language", "lang_pred", "kept", "label", "node", "_id", "line_key", "item"]


def test_columns_of_any_name_stay(spark):
    """Values of columns with inner names come out as they went in."""
    line = "one two three four five six seven"
    rows = [(i, f"{line}\nown words of {i} and more of them to tell it apart from the others {i * 7}", f"s{i}", *[f"{c}{i}" for c in CLASHING]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    items = spark.createDataFrame([(1, "own words of 3 and more of them to tell it apart")], "item_id long, text string")
    for got, gone, named in (
        (line_dedup.dedup_lines(docs), set(), ["n_lines", "n_removed"]), (jaccard_join.keep_one(docs), set(), []), (decontaminate.drop_leaks(docs, items), {3}, []),
        (corpus_pipeline.language_id(spark, docs, SF), set(), []), (corpus_pipeline.line_dedup_stage(spark, docs, SF), set(), []),
    ):
        assert set(got.columns) == {*docs.columns, *named}
        assert got.columns == [*[c for c in docs.columns if c not in named], *named]
        kept = {r.doc_id: [r[c] for c in CLASHING if c not in named] for r in got.collect()}
        assert kept == {i: [f"{c}{i}" for c in CLASHING if c not in named] for i in range(6) if i not in gone}


def test_lines_by_value(spark):
    shared, rare = "this line has six words or more", "another line with enough words here"
    rows = [(0, f" {shared} \nx", "a"), (1, f"{shared}\n{shared}", "b"), (None, shared, "c"), (3, shared, "d"), (4, shared, "e"), (5, f"{rare}\n", "a"), (6, rare, "a"), (7, rare, None), (8, None, "a"), (9, "", "b"), (3, shared, "d")]
    found = sorted(((r.doc_id if r.doc_id is not None else -1, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=str)
    want = [(0, f" {shared} \nx", 2, 0), (1, "", 2, 2), (-1, "", 1, 1), (3, "", 1, 1), (3, "", 1, 1), (4, "", 1, 1), (5, f"{rare}\n", 2, 0), (6, rare, 1, 0), (7, rare, 1, 0), (8, None, 0, 0), (9, "", 1, 0)]
    assert found == sorted(want, key=str)


def test_long_texts(spark):
    """A text of more than a segment beside small ones, in every operator that holds words."""
    words = random.Random(1).choices([f"w{k}" for k in range(3000)], k=450_000)
    assert len(" ".join(words)) > lm.SEGMENT
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s"), (2, "a short one", "en", "s")], "doc_id long, text string, lang string, source string").repartition(2)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert {r.doc_id: r.n_tokens for r in lm.score_texts(docs, F.lit(False), path, public_tokenizers.PATTERN).collect()} == {1: 450_001, 2: 4}
    assert {r.doc_id: r.n_words for r in quality.judge_quality(docs, {}).collect()} == {1: 450_000, 2: 3}
    assert jaccard_join.near_duplicates(docs).where("n_links = 0").count() == 2
    assert langid.predict_language(docs, langid.fit_profiles(docs)).where("lang_pred = 'en'").count() == 2


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        shared_dir(Session)
