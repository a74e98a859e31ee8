"""The training-data operators against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepweave.llm import bpe, decontaminate, fingerprints, jaccard_join, language_id, license_scan, line_dedup, pii, secret_scan, toxicity
from stepweave.llm import queries as Q
from stepweave.llm.common import table
from stepweave.llm.textnp import distinct, ngrams, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def documents(spark, texts, langs=None, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\n ", "a", "The quick brown fox jumps over the lazy dog. " * 3, "word " * 20_000, "ünï © 日本語 🙂", "x" * 50_000]


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op2_secret_scan", "op3_line_dedup", "op6_fingerprints", "op8_license_scan", "op9_decontamination"])
def test_same_as_sql(name, same_rows):
    same_rows(Q.queries()[name], Q.oracle_sql()[name], some=not name.startswith("op2"))  # the smallest tables have no secrets


# -- 1 --


def brute_pairs(texts, n, threshold):
    sets = {}
    for i, t in enumerate(texts):
        if t is not None:
            sets[i] = set(ngrams(words([t]), n)[0].tolist())
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize(("n", "threshold", "seed"), [(1, 0.5, 1), (2, 0.6, 2), (3, 0.8, 3)])
def test_all_similar_pairs_are_found(spark, n, threshold, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(3, 40))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(w if rng.random() > 0.08 else "zz" + str(rng.randint(0, 9)) for w in base))
    texts += [None, "", "", "one"]
    docs, want = documents(spark, texts), brute_pairs(texts, n, threshold)
    assert want
    got = {(r.a, r.b) for r in jaccard_join.jaccard_edges(docs, n, threshold, all_pairs=True).collect()}
    assert got == want
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    sets = [None if t is None else frozenset(ngrams(words([t]), n)[0].tolist()) for t in texts]
    of = lambda i: min(j for j, s in enumerate(sets) if s == sets[i])
    links = {i: len({of(a + b - i) for a, b in want if i in (a, b)} - {of(i)}) for i in {x for p in want for x in p}}
    for known, block in ((10**6, 500), (1, 3), (0, 1)):
        rows = jaccard_join.near_duplicate_groups(docs, n, threshold, known_grouped=known, block=block).collect()
        assert {r.doc_id: (r.group_id, r.class_id, r.n_links) for r in rows} == {i: (root(i), of(i), k) for i, k in links.items()} and len(rows) == len(links)


def test_equal_texts_bring_no_pairs(spark):
    docs = documents(spark, ["the same few words in all of these"] * 300 + ["the same few words in all of those"] * 5)
    for known in (10**6, 0):
        assert jaccard_join.jaccard_edges(docs, 2, 0.6, known_grouped=known).count() == 304
    rows = jaccard_join.near_duplicate_groups(docs, 2, 0.6, known_grouped=0).collect()
    assert {(r.group_id, r.group_size, r.class_id, r.n_links) for r in rows} == {(0, 305, 0, 1), (0, 305, 300, 1)}


def test_components_the_other_way(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (3, 7), (9, 11)], "a long, b long")
    assert {tuple(r) for r in jaccard_join.components(edges, one_task=1).collect()} == {tuple(r) for r in jaccard_join.components(edges).collect()}


# -- 2 --


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    rules = (secret_scan.Rule("r", 1, "key[0-9]"), secret_scan.Rule("s", 1, "pw[0-9]"))
    ledger = secret_scan.Ledger(spark, str(tmp_path / "l"))
    rows = [("a", "1", "key1 pw1 key1"), ("b", "1", "key1 pw1 key1"), ("b", "1", "key1 pw1 key1"), ("c", "1", None), ("d", "1", ""), (None, None, "key2")]
    df = spark.createDataFrame(rows, "path string, version string, text string")
    first = {(r.path, r.rule): r.n for r in secret_scan.scan(df, ledger, rules).collect()}
    assert first == {("a", "r"): 2, ("a", "s"): 1, ("b", "r"): 2, ("b", "s"): 1, (None, "r"): 1}
    assert ledger.scanned().count() == 3
    more = df.union(spark.createDataFrame([("e", "2", "key1 pw1 key1"), ("f", "1", "pw9")], df.schema))
    assert {(r.path, r.rule) for r in secret_scan.scan(more, ledger, rules).collect()} >= {("e", "r"), ("f", "s")}
    assert ledger.scanned().count() == 4  # one new blob
    newer = (secret_scan.Rule("r", 2, "key[13]"), rules[1])
    got = {(r.path, r.rule, r.rule_version) for r in secret_scan.scan(more, ledger, newer).collect()}
    assert ("a", "r", 2) in got and (None, "r", 2) not in got and ("a", "r", 1) not in got
    assert {tuple(r.rules) for r in ledger.scanned().collect()} == {("r:1", "s:1"), ("r:2",)}
    assert secret_scan.scan(df.limit(0), secret_scan.Ledger(spark, str(tmp_path / "e")), rules).count() == 0


# -- 3 --


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_spread_lines(spark, broadcast_rows):
    spread, near, own = "this line is everywhere", "this one is on two sites", "said twice by one site"
    texts = [f"{spread}\nfirst", f"x\n  {spread} ", f"{near}\n{spread}\n{spread}", f"{near}\nshort\nshort", f"{own}\n{own}", None, "", f"{spread}"]
    docs = documents(spark, texts, sources=["a", "b", "c", "a", "a", "a", "b", None]).withColumn("n_removed", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_spread_lines(docs, 3, 10, removed_col="n_removed", broadcast_rows=broadcast_rows).collect()}
    assert got == {0: (texts[0], 0), 1: ("x", 1), 2: (near, 2), 3: (texts[3], 0), 4: (texts[4], 0), 5: (None, 0), 6: ("", 0), 7: ("", 1)}
    assert line_dedup.remove_spread_lines(docs.limit(0), 3, 10).count() == 0


# -- 4 --


def test_bpe_is_that_of_its_definition_and_round_trips(spark):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(bpe.RANKS)
    theirs, mine, back = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(ranks), bpe.Decoder(ranks)
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["it's  we'll\r\n\t x\x1c\x85", "½ x² Ⅷ ٣٤ 𝔘𝔫", "a" * 3000] + ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FFF), 0x1F600])) for _ in range(60)) for _ in range(200)]
    texts += [r.text for r in table(spark, DATA, "documents").select("text").collect()]
    for t in texts:
        ids = mine.encode(t)
        assert ids == theirs.encode_ordinary(t) and back.decode(ids) == t
    ids, upto = mine.batch(pa.array([None, *texts, ""]).slice(1))
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [theirs.encode_ordinary(t) for t in [*texts, ""]]
    assert "".join(back.stream(iter(ids.tolist()), 7)) == "".join(texts)
    for t in texts:
        cuts = sorted(rng.randint(0, len(t)) for _ in range(3))
        assert sum(mine.stream(t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)), []) == theirs.encode_ordinary(t)
    for piece in (b"understanding", b"\xff\xfe", b"aaaaab", *(bytes(rng.choice(b"abcderst\xc3\xa9  ing") for _ in range(40)) for _ in range(300))):
        want = bpe.merge(piece, ranks)
        assert mine.transducer.encode(piece) == want and list(mine.transducer.stream(piece[i : i + 3] for i in range(0, len(piece), 3))) == want
    with pytest.raises(KeyError):
        back.decode([10**9])


def test_utf8_by_bits():
    data = "aé日🙂".encode() + b"\xff\xe6\x97" + b"z\xf0\x9f"
    for k in (1, 2, 3, 5):
        s = bpe.Utf8Stream()
        assert "".join([s.feed(data[i : i + k]) for i in range(0, len(data), k)] + [s.end()]) == data.decode("utf-8", "replace")


def test_bpe_documents(spark):
    docs = documents(spark, ODD).withColumn("N_TOKENS", F.lit("clash"))
    out = bpe.encode_documents(docs, check=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].token_ids is None and rows[0].n_tokens == 0 and rows[1].token_ids == [] and all(r.round_trip for i, r in rows.items() if i)
    assert {r.doc_id: r.text for r in bpe.decode_documents(out.drop("text")).collect()} == dict(enumerate(ODD))


# -- 5 --


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_is_the_edit_distance():
    m, rng = toxicity.Matcher(toxicity.Lexicon()), random.Random(2)
    terms = list(toxicity.BUILT_IN)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.choice("abcdefghijklmnopqrstuvwxyz")]])
        word = "".join(w)
        want = min((distance(word, t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t)), default=None)
        got = m.word(word) if word else None
        assert (got and got[1]) == want or (got is None and want is None), word


def test_abuse_and_quotation(spark):
    m = toxicity.Matcher(toxicity.Lexicon())
    texts = ["you are an idiot", "you id1iot", 'he wrote "idiot" on it', "a calm day", "", None, "you stupd morron"]
    scores = [s for s, _, _ in m.scores(texts)]
    assert [s >= toxicity.THRESHOLD for s in scores] == [True, True, False, False, False, False, True]
    docs = documents(spark, texts).withColumn("score", F.lit("clash"))
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, toxicity.Lexicon()).collect()) == [2, 3, 4, 5]
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == toxicity.Lexicon()


def test_unpaired_marks_quote_nothing():
    m, far = toxicity.Matcher(toxicity.Lexicon()), "and so on " * 100
    bad = ['A 6" pipe, you idiot and moron, not a 7" one', f'He "never ended. {far}you idiot, you moron. {far}A 5" pipe', 'So "a" you idiot and moron "b" it is', 'An "open mark, idiot, then "b" follows', "So “open, idiot and moron, then “b” it is"]
    good = ['he wrote "idiot" on it', f'A 6" pipe. {far} They have "an idiot, all in all" there', '("idiot")', "“such an idiot”", "„idiot“ it is", "«idiot»", '"What an idiot!" was heard']
    assert [s >= toxicity.THRESHOLD for s, _, _ in m.scores(bad)] == [True] * len(bad)
    assert [s >= toxicity.THRESHOLD for s, _, _ in m.scores(good)] == [False] * len(good)


def test_misspelled_learned_terms(spark):
    rng = random.Random(6)
    plain = [f"{a}{b}en" for a in ("kal", "mor", "tis", "wem", "fol") for b in ("dor", "lim", "sak", "zup")]
    say = lambda *more: " ".join([*rng.choices(plain, k=12), *more, *rng.choices(plain, k=12)])
    texts = [say("zorblatten") for _ in range(60)] + [say("quibblor") for _ in range(60)] + [say(rng.choice(["quibbler", "quibblot", "harmless"])) for _ in range(300)]
    labels = spark.createDataFrame([(k, int(k < 120)) for k in range(len(texts))], "doc_id long, toxic int")
    lexicon = toxicity.learn(documents(spark, texts), labels)
    assert {"zorblatten", "quibblor"} <= set(lexicon.terms) and "quibblor" in lexicon.exact and "zorblatten" not in lexicon.exact
    scores = [s >= toxicity.THRESHOLD for s, _, _ in toxicity.Matcher(lexicon).scores([say("zorblatten"), say("zorblaten"), say("zorblqtten"), say("quibblor"), say("quibbler"), say("quibblox"), say()])]
    assert scores == [True, True, True, True, False, False, False]


# -- 6 --


def test_fingerprints(spark):
    p = [f"paragraph number {k} of some length" for k in range(8)]
    a, b = "\n".join(p[:4]) + "\n\n" + "\n".join(p[4:]), "\n".join(p[:4]) + "\n\n" + "\n".join([p[4], "quite another paragraph here", *p[6:]])
    docs = documents(spark, [a, a + "  \n", b, None, "", " \n\n", "alone"])
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert rows[0].root == rows[1].root != rows[2].root and rows[1].same_as == 0 and rows[1].base_id is None
    assert (rows[2].base_id, rows[2].changed, rows[2].removed) == (0, ["2.2"], ["2.2"]) and (rows[0].n_sections, rows[0].n_paragraphs) == (2, 8)
    assert rows[3].root is None and rows[3].same_as is None and rows[4].root == rows[5].root and rows[6].base_id is None
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("paired", "share"), [(64, 0.5), (2, 0.5), (1, 0.3), (3, 1.0)])
def test_bases_against_brute_force(spark, paired, share):
    rng = random.Random(11)
    p = [f"paragraph number {k} of some length" for k in range(40)]
    hot = [f"this one is in nearly all of them {k}" for k in range(6)]
    texts = [None, "", "short\nones", *("\n".join(rng.sample(hot, rng.randint(0, 6)) + rng.sample(p, rng.choice([0, 1, 2, 5])) + [f"of its own {k}" + "x" * 20] * (k % 3 == 0)) for k in range(150))]
    docs = documents(spark, texts)
    sets = {k: {x for x in (t or "").split("\n") if len(x) >= 20} for k, t in enumerate(texts)}
    roots = {k: (t if t is None else tuple(x for x in t.split("\n") if x)) for k, t in enumerate(texts)}
    want = {}
    for k, mine in sets.items():
        if roots[k] is not None and not any(roots[j] == roots[k] for j in range(k)):
            best = max(((len(mine & sets[j]), -j) for j in range(k)), default=(0, 0))
            if best[0] and best[0] >= share * len(mine) - 1e-9:
                want[k] = -best[1]
    rows = fingerprints.fingerprints(docs, min_share=share, paired=paired).collect()
    assert {r.doc_id: r.base_id for r in rows if r.base_id is not None} == want and want
    assert len(rows) == len(texts)


# -- 7 --


def test_language_of_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    held = language_id.identify(docs.where("doc_id % 2 = 1 and n_chars > 40"), model)
    r = held.agg(F.avg((F.col("lang") == F.col("language")).cast("int")).alias("right"), F.min("confidence").alias("low")).first()
    assert r.right > 0.98 and r.low > 0.25
    assert 0 < np.mean(model.weights != 0) < 0.3 and model.temperature > 0


def test_language_cases(spark):
    docs = documents(spark, ["der hund und die katze", "the dog and the cat", None, "", "123 !"] * 10, langs=["de", "en", "en", None, None] * 10).withColumn("confidence", F.lit("clash"))
    rows = language_id.identify(docs, language_id.fit(docs)).collect()
    assert [(r.language, r.confidence is None) for r in sorted(rows, key=lambda r: r.doc_id)[:5]] == [("de", False), ("en", False), (None, True), (None, True), (None, True)]
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.language for r in language_id.identify(none, language_id.fit(none)).collect()} == {None}
    assert language_id.identify(docs.limit(0), language_id.fit(docs.limit(0))).count() == 0


# -- 8 --


@pytest.mark.parametrize(("threshold", "at_once"), [(0.85, 10**6), (0.5, 20)])
def test_license_blocks_against_brute_force(spark, threshold, at_once):
    rng = random.Random(4)
    texts = [None, "", "Released under the MIT License."]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(list(license_scan.TEMPLATES.values())).split()
            w = [x for x in w if rng.random() > rng.choice([0, 0.1, 0.4])] + ["filler"] * rng.randint(0, 3)
            rng.shuffle(w)
            cut = rng.randint(0, len(w))
            lines += [" ".join(w[:cut]), " ".join(w[cut:])] if rng.random() < 0.4 else [" ".join(w)]
            lines += [""] * (rng.random() < 0.3)
        texts.append("\n".join(lines))
    sets = {n: set(words([t]).hash.tolist()) for n, t in license_scan.TEMPLATES.items()}
    want = set()
    for d, t in enumerate(texts):
        runs, run = [], []
        for k, line in enumerate([*(t or "").split("\n"), ""], 1):
            if line.strip():
                run.append((k, line))
            elif run:
                runs.append(run)
                run = []
        for run in runs:
            hit = {}
            for k, line in run:
                hit[k, 1] = {n for n, s in sets.items() if len(s & set(words([line]).hash.tolist())) >= np.ceil(threshold * len(s) - 1e-9)}
            seen = set().union(*hit.values())
            if len(run) > 1:
                every = set(words(["\n".join(x for _, x in run)]).hash.tolist())
                hit[run[0][0], len(run)] = {n for n, s in sets.items() if len(s & every) >= np.ceil(threshold * len(s) - 1e-9)} - seen
            want |= {(d, k, m, n) for (k, m), found in hit.items() for n in found}
    docs = documents(spark, texts)
    got = {(r.doc_id, r.line, r.n_lines, r.template) for r in license_scan.license_matches(docs.union(docs), threshold=threshold, template_words=at_once).collect()}
    assert got == want and want
    assert license_scan.license_matches(docs, {}).count() == 0 and license_scan.license_matches(docs.limit(0)).count() == 0
    assert len(distinct(np.array([3, 1, 3]))) == 2


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice."""


def test_licenses_of_several_paragraphs(spark, tmp_path):
    texts = [APACHE, f"\n\nTitle\n\n  \n{MIT}\n\nTHE SOFTWARE IS PROVIDED AS IS\n", f"Copyright\n\n{BSD}"]
    far = MIT.split("\n\n")
    texts += [f"{far[0]}\n\n{'other words ' * 100}\n\n{far[1]}", MIT.replace("\n\n", "\n"), f"{MIT}\n\n{'other words ' * 100}\n\n{MIT}"]
    rng = random.Random(9)
    for _ in range(40):  # licenses with words between, cut and mixed
        parts = [x for t in rng.sample([APACHE, MIT, BSD], 2) for x in t.split("\n\n")] + ["other words"] * rng.randint(0, 3)
        rng.shuffle(parts)
        texts.append(rng.choice(["\n\n", "\n \n\n"]).join(parts[: rng.randint(1, len(parts))]))
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    names = ("apache-2.0-header", "mit-text", "bsd-3-clause")
    got = sorted((r.doc_id, r.line, r.n_lines, r.template) for r in Q.op8_license_scan(spark, str(tmp_path)).collect() if r.template in names and r.doc_id < 6)
    assert got == [(0, 1, 11, names[0]), (1, 6, 9, names[1]), (2, 3, 5, names[2]), (4, 1, 8, names[1]), (5, 1, 9, names[1]), (5, 13, 9, names[1])]
    duckdb = pytest.importorskip("duckdb")
    want = duckdb.connect().execute(Q.OP8_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    every = Q.op8_license_scan(spark, str(tmp_path))
    assert sorted(map(tuple, every.select("doc_id", "line", "n_lines", "template", "shared", "template_words").collect())) == sorted(want) and any(r[2] > 1 and r[0] > 5 for r in want)


# -- 9 --


def test_benchmark_phrases_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(30)]
    texts = []
    for k in range(120):
        own = rng.choices(vocabulary, k=rng.randint(0, 80))
        if k % 3 == 0:
            w = items[k % 30].split()
            i = rng.randint(0, max(0, len(w) - 13))
            own[len(own) // 2 : 0] = w[i : i + rng.choice([12, 13, 20])]
        texts.append(" ".join(own).title())
    texts += [None, "", items[0]]

    def has(item, text):
        a, b = item.split(), (text or "").lower().split()
        n = min(13, len(a))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))

    want = {(k, d) for k, x in enumerate(items) for d, t in enumerate(texts) if has(x, t)}
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    docs = documents(spark, texts)
    got = {(r.item_id, r.doc_id): r.kind for r in decontaminate.benchmark_matches(docs, bench).collect()}
    assert {p for p, kind in got.items() if kind == "phrase"} == want
    slices = {(r.item_id, r.doc_id): r.kind for r in decontaminate.benchmark_matches(docs, bench, item_chars=1500, search_chars=400).collect()}
    assert slices == got
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for _, d in got}
    assert decontaminate.benchmark_matches(docs, bench.limit(0)).count() == 0 and decontaminate.benchmark_matches(docs.limit(0), bench).count() == 0


def test_benchmark_of_very_many_words_and_items(spark):
    items = [" ".join(f"v{k}x{j}" for j in range(2)) + " of item" + f" n{k}" for k in range(70_000)]  # over 200,000 distinct words
    long = [" ".join(f"long{k}w{j}" for j in range(20)) for k in range(200)]
    places = [0, 4_463, 32_767, 32_768, 40_000, 65_535, 65_536, 69_999]
    texts = [" ".join(["before", items[k], "after"]) for k in places] + [" ".join(["before", *reversed(items[k].split())]) for k in places]
    # two items of one document, 65,536 apart, each with too few of its words
    texts += [" ".join([*items[4_463].split()[:2], *items[69_999].split()[:2]])]
    texts += ["x " + " ".join(t.split()[3:17]) for t in long]
    bench = spark.createDataFrame(list(enumerate([*items, *long])), "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.kind for r in decontaminate.benchmark_matches(documents(spark, texts), bench).collect()}
    n = len(places)
    want = {(k, d): "phrase" for d, k in enumerate(places)} | {(k, n + d): "proximity" for d, k in enumerate(places)}
    assert got == want | {(70_000 + k, 2 * n + 1 + k): "phrase" for k in range(len(long))}


def test_short_benchmark_items(spark):
    items = ["Paris", "the answer is 42", "who wrote it", "", "one two three four five"]
    texts = ["In PARIS, paris and Paris", "so the answer: is 42!", "the 42 answer is", "it wrote who", "a one two three four five b", "the answer is", None, ""]
    docs, bench = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.item_id, r.doc_id, r.kind, r.place, r.n_words) for r in decontaminate.benchmark_matches(docs, bench).collect())
    assert got == [(0, 0, "phrase", 1, 1), (1, 1, "phrase", 1, 4), (4, 4, "phrase", 1, 5)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [0, 1, 2, 3, 5, 6, 7]


# -- 10 --


def test_values_are_found_whole():
    t = "Mail a.b+c@mail.example.com, call +1 (336) 555-3810 4713403953524564 10.0.0.255 from GB82 WEST 1234 5698 7654 32; SSN 123-45-6789"
    assert [k for *_, k, _ in pii.mentions(t)] == ["EMAIL", "PHONE", "CARD", "IP", "ACCOUNT", "SSN"]
    assert [k for *_, k, _ in pii.mentions("card:4713403953524564,tel:+1 (336) 555-3810; (ip=10.1.2.3)")] == ["CARD", "PHONE", "IP"]
    for clean in ("7086638319846192", "version 1.2.3.4.5", "2024-01-02 10:00:00", "300.1.1.1", "a @ b", "x@y", "12345678", ""):
        assert not pii.mentions(clean), clean


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_disclosing_terms_against_brute_force(spark, broadcast_rows):
    around = ["blue", "red", "green", "grey", "pink"]
    texts = [f"{c} Zanzibar {d} ann@x.org often {c}" for c, d in zip(around, reversed(around), strict=True)]
    texts += ["often we go there", "often too", "they often stay", "often and often", "nothing to see", None, ""]
    texts += ["copy Quux copy bob@x.org"] * 9  # copies of one context disclose nothing
    docs = documents(spark, texts).withColumn("n_terms", F.lit("clash"))
    rows = {r.doc_id: r for r in pii.sanitise(docs, broadcast_rows=broadcast_rows).collect()}
    assert all("ann@x.org" not in (r.text or "") and "Zanzibar" not in (r.text or "") for r in rows.values())
    assert rows[0].n_entities == 1 and rows[5].text == texts[5].replace("often", rows[5].text.split()[0]) and rows[9].text == texts[9]
    assert rows[10].text is None and rows[11].text == "" and rows[12].text == "copy Quux copy [EMAIL]"
    # often: 5 of its 10 places are near ann, one bit is left: generalised
    assert rows[6].text == "[TERM] too"
    assert pii.sanitise(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "contexts", "broadcast_rows"), [(1, 1, 10**6), (2, 2, 10**6), (3, 2, 0)])
def test_what_is_left_against_brute_force(spark, seed, contexts, broadcast_rows):
    rng = random.Random(seed)
    vocabulary, mails = [f"word{chr(97 + k)}" for k in range(20)], [f"user{chr(97 + k)}@mail.org" for k in range(4)]
    texts = []
    for _ in range(60):
        t = rng.choices(vocabulary, k=rng.randint(0, 25)) + ["usera"] * (rng.random() < 0.2)
        for _ in range(rng.choice([0, 0, 1, 2])):
            t.insert(rng.randint(0, len(t)), rng.choice(mails))
        texts.append(" ".join(t))
    texts += texts[:5] + [None, ""]
    n, both, seen = Counter(), Counter(), defaultdict(set)
    for t in texts:
        tokens = [(x, m) for m in (t or "").split() for x in (m.replace("@", " ").replace(".", " ").split())]
        inside = [m in mails for _, m in tokens]
        for k, (x, _) in enumerate(tokens):
            if not inside[k] and len(x) >= 3:
                n[x] += 1
                # words of entities count as places: three for each of these
                for e in {m for i, (_, m) in enumerate(tokens) if inside[i] and abs(i - k) <= 8}:
                    both[x, e] += 1
                    seen[x, e].add(tuple(tokens[j][0] if 0 <= j < len(tokens) and not inside[j] else None for j in (k - 1, k + 1)))
    left = {}
    for (x, e), b in both.items():
        if len(seen[x, e]) >= contexts:
            left[x] = min(left.get(x, 99), np.log2(n[x] / b))
    want = sorted(round(v, 9) for v in left.values() if v < 2.5)
    docs = documents(spark, texts)
    got = pii.disclosures(docs, contexts=contexts, generalise=2.5, broadcast_rows=broadcast_rows).collect()
    assert sorted(round(r.left, 9) for r in got) == want and want and all(r.gone == (r.left < pii.REMOVE) for r in got)


def test_places_inside_entities_do_not_count(spark):
    docs = documents(spark, ["Annabel wrote from annabel@x.org", "so Annabel has annabel@x.org", "it is Annabel at annabel@x.org now", "mail annabel@x.org mail"])
    rows = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("nnabel" not in t for t in rows.values())


# -- everything over odd tables --


def test_odd_tables(spark):
    docs = documents(spark, [*ODD, *ODD], ids=[None, 1, 2, 3, 4, 5, 6, 7] * 2).withColumn("toxic", F.lit("x")).withColumn("score", F.lit(1))
    docs = docs.withColumn("source", F.when(F.col("doc_id") != 3, F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    n = docs.count()
    assert jaccard_join.drop_near_duplicates(docs).count() <= n and jaccard_join.near_duplicate_groups(docs).count() >= 0
    assert secret_scan.scan_documents(docs).count() == 0
    for out in (line_dedup.remove_spread_lines(docs), bpe.encode_documents(docs), toxicity.toxicity_scores(docs, toxicity.Lexicon()), language_id.identify(docs, language_id.fit(docs)), pii.sanitise(docs)):
        assert out.count() == n
    assert fingerprints.fingerprints(docs).count() == n - 2
    assert license_scan.license_matches(docs).count() == 0
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, "x")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.benchmark_matches(docs, bench).collect()} == {4}
