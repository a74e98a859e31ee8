import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline as P
from stepweave.llm import bpe, toxicity
from stepweave.llm.textnp import ngrams, words

D = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = P.run(spark, D)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
    rows = out.collect()
    kept = {r.doc_id for r in rows}
    assert len(rows) == len(kept) and 0.3 * docs.count() < len(kept) < docs.count()
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, D).columns == docs.columns
        assert stage(spark, docs.limit(0), D).count() == 0


# -- the same by brute force, without Spark --


def no_spread_lines(docs):
    sites, first = defaultdict(set), {}
    for i in sorted(docs):
        source, text = docs[i]
        for k, line in enumerate(text.split("\n")):
            if len(bare := line.strip(" ")) >= 10:
                sites[bare].add(source)
                first.setdefault(bare, (i, k))
    stays = lambda i, k, line: len(sites.get(b := line.strip(" "), ())) < 3 or first[b] == (i, k)
    return {i: (s, "\n".join(x for k, x in enumerate(t.split("\n")) if stays(i, k, x))) for i, (s, t) in docs.items()}


def one_of_each_group(docs):
    sets, parent = {i: set(ngrams(words([t]), 2)[0].tolist()) for i, (_, t) in docs.items()}, {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(docs), 2):
        if min(len(sets[a]), len(sets[b])) >= 0.6 * max(len(sets[a]), len(sets[b])) - 1e-9 and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: d for i, d in docs.items() if root(i) == i}


def without_passages(docs, items):
    split = lambda t: re.findall(r"\w+", t.lower().replace("_", " "))
    texts = {i: split(t) for i, (_, t) in docs.items()}
    totals, bad = Counter(w for t in texts.values() for w in t), set()
    for item in map(split, items):
        if len(item) < 5:
            continue
        n = min(13, len(item))
        phrases = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
        rare = sorted(dict.fromkeys(item), key=lambda w: totals[w])[:8]
        need, span = max(3, math.ceil(0.75 * len(rare))), math.ceil(1.5 * len(item))
        for i, t in texts.items():
            at = [k for k, w in enumerate(t) if w in rare]
            if any(tuple(t[k : k + n]) in phrases for k in range(len(t) - n + 1)) or any(len({t[j] for j in at if k <= j < k + span}) >= need for k in at):
                bad.add(i)
    return {i: d for i, d in docs.items() if i not in bad}


def test_run_against_brute_force(spark):
    tiktoken = pytest.importorskip("tiktoken")
    table = spark.read.parquet(f"{D}/documents.parquet")
    docs = {r.doc_id: (r.source or "\0", r.text) for r in table.collect() if r.text is not None}
    lexicon = toxicity.learn(table, spark.read.parquet(f"{D}/labels.parquet"))
    scores = toxicity.Matcher(lexicon).scores([t for _, t in docs.values()])
    docs = {i: d for (i, d), (score, _, _) in zip(docs.items(), scores, strict=True) if score < toxicity.THRESHOLD}
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect() if r.text]
    docs = without_passages(one_of_each_group(no_spread_lines(docs)), items)
    coder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    got = {r.doc_id: r.token_ids for r in P.run(spark, D).collect() if r.token_ids is not None}
    assert got == {i: coder.encode_ordinary(t) for i, (_, t) in docs.items()}
