"""The pipeline against a brute-force version of its five stages on the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from trailmark.llm import langid

SF = "/root/testdata/sf0.001"


def long_line(line):
    return len([w for w in line.strip(" ").split(" ") if w]) >= 6


def bundled(text):
    """The plain sum of bound trigram vectors, and how many there are."""
    letters, out, n = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text} ".lower())), np.zeros(langid.DIMENSIONS), 0
    for gram, times in Counter(zip(letters, letters[1:], letters[2:], strict=False)).items():
        if gram[1] != " ":
            a, b, c = (langid.letter_vector(0 if x == " " else ord(x)).astype(float) for x in gram)
            out, n = out + times * np.roll(a, 2) * np.roll(b, 1) * c, n + times
    return out, n


def in_a_language(docs):
    """Documents with a letter that aren't far from every language: fifty trigrams and no cosine of 0.2."""
    made, prototypes = [bundled(d[1] or "") for d in docs], defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for d, (v, _) in zip(docs, made, strict=True):
        if d[1] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 4 != 2:
            prototypes[d[3]] += v

    def near(v):
        return max(v @ p / (np.linalg.norm(v) * np.linalg.norm(p)) for p in prototypes.values())

    return [d[:3] for d, (v, n) in zip(docs, made, strict=True) if any(c.isalpha() for c in d[1] or "") and not (n >= 50 and near(v) < 0.2)]


def brute(docs, items):
    docs = in_a_language(docs)
    sites, first = defaultdict(set), {}
    for i, text, source in docs:
        for line in map(lambda x: x.strip(" "), filter(long_line, text.split("\n"))):
            sites[line].add(source)
            first[line] = min(i, first.get(line, i))
    cut = []
    for i, text, _ in docs:
        lines = text.split("\n")
        kept = [x for x in lines if not (long_line(x) and len(sites[x.strip(" ")]) >= 5 and first[x.strip(" ")] != i)]
        if len(kept) == len(lines) or "".join(kept).strip(" "):
            cut.append((i, "\n".join(kept)))
    words = [(i, t.lower().encode().split()) for i, t in cut]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, w in words]
    group = list(range(len(cut)))
    for a in range(len(cut)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    least = {}
    for k, (i, t) in enumerate(cut):
        least[group[k]] = min(least.get(group[k], (i, t)), (i, t))
    return {i: t for i, t in least.values() if not any(x in t for x in items)}


def test_run_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(ids := own.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, t in brute(docs, items).items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_texts_in_no_language_go(spark):
    """A text whose letters belong to none of the languages goes; short and mixed ones stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = " ".join("".join(chr(0x430 + (7 * i + 3 * k) % 32) for k in range(5)) for i in range(60))
    more = spark.createDataFrame([(10**6, strange, "en", "s", 1), (10**6 + 1, strange[:20], "en", "s", 1), (10**6 + 2, "12 34", "en", "s", 1), (10**6 + 3, None, "en", "s", 1)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(more.where("doc_id is not null")), SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()} | {10**6 + 1}
