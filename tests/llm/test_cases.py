"""Every operator and stage over tables with clashing column names, odd ids, nulls, repeated rows, and no rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stepweave.llm import bpe, decontaminate, fingerprints, jaccard_join, language_id, license_scan, line_dedup, pii, secret_scan, toxicity
from stepweave.llm.textnp import words

SPREAD = "this line is on very many sites"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
TEXTS = [
    None, "", " \n ", f"{SPREAD}\nthe first of two texts that are nearly the same, word by word by word", f"{SPREAD}\nthe first of two texts that are nearly the same, word by word by words", "you are an idiot and a moron",
    f"so {ITEM} it goes", "Released under the MIT License.", "mail ann@x.org now", 'password = "abcdefghijklmnop1234"', f"{SPREAD}\nein langer text der die sprache zeigt und nicht mehr", "w " * 30_000,
]
TOKENS = "_text _cleaned _id _places key _key _terms _toxicity Score N_TOKENS SCORES cleaned as_it_was sought label id a b c0 c1 ids terms row todo blob Language n_Entities REMOVED n root sections group_id h grams place path version n_links Toxic".split()


def table(spark, id_col="doc_id", text_col="text", site_col="source", lang_col="lang", ids=None, extra=()):
    rows = [(ids[k if k < len(TEXTS) else k - 9] if ids else k if k < len(TEXTS) else k - 9, t, "abc"[k % 3] if k % 5 else None, None if k % 4 == 0 else "en" if k < 10 else "de") for k, t in enumerate([*TEXTS, *TEXTS[3:6]])]
    df = spark.createDataFrame(rows, f"`{id_col}` {'string' if ids else 'long'}, `{text_col}` string, `{site_col}` string, `{lang_col}` string")
    return df.withColumns({c: F.lit("x") if k % 3 else F.lit(None).cast("string") for k, c in enumerate(extra)})


def every(spark, id_col="doc_id", text_col="text", site_col="source", lang_col="lang"):
    by, only = {"id_col": id_col, "text_col": text_col}, {"text_col": text_col}
    bench = spark.createDataFrame([(1, ITEM), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([("5", "1"), (None, "1"), ("6", "0"), ("x", "no")], "doc_id string, toxic string")
    history = lambda d: d.withColumn("path of it", F.lit("p")).withColumn("ver.sion", F.lit(None).cast("string"))
    return {
        "1": lambda d: jaccard_join.near_duplicate_groups(d, **by),
        "1 otherwise": lambda d: jaccard_join.near_duplicate_groups(d, **by, known_grouped=0, block=1),
        "1 drop": lambda d: jaccard_join.drop_near_duplicates(d, **by),
        "2": lambda d: secret_scan.scan(history(d), secret_scan.Ledger(spark, secret_scan.new_path(spark, "ledger")), path_col="path of it", version_col="ver.sion", text_col=text_col),
        "3": lambda d: line_dedup.remove_spread_lines(d, 2, 10, **by, site_col=site_col, removed_col="removed"),
        "3 otherwise": lambda d: line_dedup.remove_spread_lines(d, 2, 10, **by, site_col=site_col, broadcast_rows=0),
        "4": lambda d: bpe.encode_documents(d, **only, check=True),
        "4 decode": lambda d: bpe.decode_documents(bpe.encode_documents(d, **only), **only),
        "5": lambda d: toxicity.toxicity_scores(d, toxicity.learn(d, labels, **by), **only),
        "5 drop": lambda d: toxicity.drop_toxic(d, toxicity.Lexicon(), **only),
        "6": lambda d: fingerprints.fingerprints(d, **by),
        "7": lambda d: language_id.identify(d, language_id.fit(d, text_col, lang_col), **only),
        "8": lambda d: license_scan.license_matches(d, **by, windows=True),
        "9": lambda d: decontaminate.benchmark_matches(d, bench, **by),
        "9 drop": lambda d: decontaminate.drop_contaminated(d, bench, **by),
        "10": lambda d: pii.sanitise(d, **only),
        "10 otherwise": lambda d: pii.sanitise(d, **only, contexts=1, broadcast_rows=0),
    }


def shown(df, columns):
    return sorted(repr([r[c] for c in columns]) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())


NAMES = ["1", "1 otherwise", "1 drop", "2", "3", "3 otherwise", "4", "4 decode", "5", "5 drop", "6", "7", "8", "9", "9 drop", "10", "10 otherwise"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_odd_ids_and_no_rows(spark, tmp_path, name):
    plain = every(spark)[name](table(spark))
    columns = plain.columns
    want = shown(plain, columns)
    assert len({c.lower() for c in columns}) == len(columns)
    crowded = every(spark)[name](table(spark, extra=[c for c in TOKENS if c.lower() not in ("doc_id", "text", "source", "lang")]))
    crowded.write.parquet(str(tmp_path / "out"))  # two columns of one name can't be written
    there = {c.lower(): c for c in crowded.columns}
    assert [x.lower() for x in want] == [x.lower() for x in shown(spark.read.parquet(str(tmp_path / "out")), [there[c.lower()] for c in columns])]
    # names with dots and blanks; ids that are texts, some of no number
    ids = [str(k) if k != 9 else "none" for k in range(len(TEXTS))]
    renamed = every(spark, "doc.id", "the text", "so.urce", "la ng")[name](table(spark, "doc.id", "the text", "so.urce", "la ng", ids=ids))
    assert renamed.count() >= len(want) - (9 in (r[0] for r in plain.collect()))
    assert every(spark)[name](table(spark).limit(0)).count() == 0


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stages_over_odd_tables(spark, tmp_path, name, stage):
    d = "/root/testdata/sf0.001"
    docs = table(spark, extra=["n_chars", "_text", "key", "Toxicity", "ids"]).withColumn("n_chars", F.lit(1).cast("long"))
    out = stage(spark, docs, d)
    out.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    if name != "byte_level_bpe":
        assert rows.columns == docs.columns
    kept = rows.groupBy("doc_id").count().count()
    assert {"toxicity": 11, "ngram_jaccard_join": 10, "line_dedup": 12, "benchmark_decontamination": 12, "byte_level_bpe": 12}[name] == kept
    assert stage(spark, docs.limit(0), d).count() == 0


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_toxicity_scores_against_brute_force():
    """Scores by plain edit distances, of texts without marks."""
    rng = random.Random(3)
    lexicon = toxicity.Lexicon(stems={"zurbl": 1.0}, own=frozenset({"idiom"}))
    plain = "the day was calm and we had tea with you and your friends she said that it is".split()
    bad = [*toxicity.BUILT_IN, "zurblen", "zurbl", "idiom"]

    def spoilt(x):
        k = rng.randrange(len(x))
        return rng.choice([x, x, x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "q" + x[k + 1 :]])

    def best(x):
        found = [(w * toxicity.EDIT_WEIGHT[e], e) for t, w in lexicon.terms.items() if (e := distance(x, t)) <= toxicity.edits_allowed(t) and not (e and x in lexicon.own)]
        return max([*found, *((w, 0) for s, w in lexicon.stems.items() if x.startswith(s))], default=None, key=lambda f: (f[0], -f[1]))

    texts = [" ".join(spoilt(rng.choice(bad)) if rng.random() < 0.2 else rng.choice(plain) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    for text, (score, n, quoted) in zip(texts, toxicity.Matcher(lexicon).scores(texts), strict=True):
        ws, abuse, quote, want = text.split(), 0.0, 0.0, [0, 0]
        for k, x in enumerate(ws):
            if f := best(x):
                want[0] += 1
                around = ws[max(0, k - toxicity.WINDOW) : k] + ws[k + 1 : k + toxicity.WINDOW + 1]
                if any(y in toxicity.REPORT for y in ws[max(0, k - 3) : k]):
                    quote, want[1] = quote + 0.3 * f[0], want[1] + 1
                else:
                    abuse += f[0] * (1.25 if any(y in toxicity.ADDRESS for y in around) else 1)
        assert (n, quoted) == tuple(want) and math.isclose(score, abuse + min(quote, toxicity.QUOTED_MOST), abs_tol=1e-5), text


def test_training_against_plain_ftrl(spark):
    """The same weights by a loop over single coordinates."""
    texts = ["der hund und die katze", "the dog and the cat", "le chien et le chat", "die sonne scheint", "the sun shines", "le soleil brille"] * 3
    labels = ["de", "en", "fr"] * 6
    idf = np.linspace(1, 3, language_id.BUCKETS)
    rows = language_id.rows_of(texts)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.5
    model = language_id.train(rows, labels, idf, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, held_out=0)
    z, n = {}, {}

    def weight(key):
        a = z.get(key, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    for _ in range(2):
        for (ids, many), label in zip(rows, labels, strict=True):
            x = {int(i): language_id.SCALE * s / many.sum() * idf[i] for i, s in zip(ids, many, strict=True)} | {-1: 1.0}
            w = {(i, k): weight((i, k)) for i in x for k in range(3)}
            logits = [sum(v * w[i, k] for i, v in x.items()) for k in range(3)]
            e = [math.exp(v - max(logits)) for v in logits]
            for k, name in enumerate(("de", "en", "fr")):
                d = e[k] / sum(e) - (name == label)
                for i, v in x.items():
                    g, old = d * v, n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, k]
                    n[i, k] = old + g * g
    used = sorted({int(i) for ids, _ in rows for i in ids})
    want = np.array([[weight((i, k)) * idf[i] * language_id.SCALE for k in range(3)] for i in used])
    assert np.allclose(model.weights[used], want, atol=1e-4) and np.count_nonzero(model.weights) == np.count_nonzero(want) > 0
    assert np.allclose(model.bias, [weight((-1, k)) for k in range(3)], atol=1e-6)
    ids, many = language_id.rows_of(["der Hund"])[0]
    assert len(ids) == len(many) and many.sum() >= len(ids) > 0 and len(words(["der Hund"]).hash) == 2
