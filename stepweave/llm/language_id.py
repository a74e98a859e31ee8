"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three letters (a word's begin and end count as a letter) are hashed into BUCKETS features. A feature's value
is its share of the text's n-grams times its inverse document frequency, which is counted over all documents. The model is
trained by follow-the-regularised-leader with per-coordinate rates and an elastic net (l1, l2): most weights are exactly
zero. Its logits are then divided by a temperature that minimises the log loss of held-out texts.

Training uses a sample of labelled rows of at most max_labelled (a parameter), chosen by hash, whole texts; it runs in one
task, to which only their features come. Scoring covers all documents, whole, and touches each n-gram once.

Defined cases: null or letterless text: language null, confidence null. No labelled rows: likewise for all. One label
only: that one, with confidence 1. Null label: not used in training. Ties: the language that is first by name. Very long
texts: whole. Repeated rows: each is scored; equal texts of one label are learned from once. Ids play no part. Empty
tables: no rows. Other columns stay; result columns replace those of the same name, in whatever case.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import carried, column, map_arrow, others, quoted, slices, texts_of
from stepweave.llm.textnp import codepoints, counted, mix, tables

BUCKETS = 1 << 16
MAX_LABELLED = 6_000
#: What divides the features' values, so that rates suit them.
SCALE = 30.0


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of all texts, and where each text's begin."""
    cps, offset = codepoints(texts)
    kind, lower = tables()
    capped = np.minimum(cps, np.uint32(len(kind) - 1))
    c = np.where(kind[capped] > 0, lower[capped], np.uint32(32)).astype(np.uint64)
    letters = c != 32
    digits = (c >= 48) & (c <= 57)
    letters &= ~digits
    c[~letters] = 32
    # runs of separators are one
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    x, inner = c[at], letters[at]
    doc = np.searchsorted(offset, at, side="right") - 1
    two, three = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    if len(x) > 2:
        same1, same2 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
        two[1:] = np.where(same1, (x[:-1] << np.uint64(21)) | x[1:] | np.uint64(1 << 62), 0)
        # the middle one is a letter
        three[2:] = np.where(same2 & inner[1:-1], (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:], 0)
    grams = np.stack([np.where(inner, x | np.uint64(1 << 63), 0), two, three], axis=1).ravel()
    docs = np.repeat(doc, 3)
    there = grams != 0
    return (mix(grams[there]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(docs[there], np.arange(len(texts) + 1))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature is; feature -1: the number of texts."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for b in slices(batches):
        f, bounds = features(texts_of(b))
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):  # faster than to sort the features of each text
            seen = np.zeros(BUCKETS, bool)
            seen[f[i:j]] = True
            total += seen
        n += b.num_rows
    there = np.flatnonzero(total)
    yield pa.record_batch({"feature": pa.array(np.append(there, -1)), "n": pa.array(np.append(total[there], n))})


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Of each feature, over all rows of texts (text)."""
    found = map_arrow(texts, _frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    df, n = np.zeros(BUCKETS), 0
    for f, k in zip(found.feature.tolist(), found.n.tolist(), strict=True):
        if f < 0:
            n = k
        else:
            df[f] = k
    return np.log((1 + n) / (1 + df)) + 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, the inverse document frequency in them
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text; and whether it has any feature."""
        f, bounds = features(texts)
        out = np.zeros((len(texts), len(self.languages)))
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.weights[f], bounds[some], axis=0) / n[some, None]
        return out + self.bias, n > 0

    def predict(self, texts: list[str | None]) -> list[tuple[str | None, float | None]]:
        if not self.languages:
            return [(None, None)] * len(texts)
        logits, some = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return [(self.languages[k], round(float(x[k]), 6)) if s else (None, None) for k, x, s in zip(best, p, some, strict=True)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def rows_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its features in order, and how often each is there."""
    f, bounds = features(texts)
    return [counted(np.sort(f[i:j])) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, held_out: float = 0.2) -> Model:
    """FTRL-proximal over the rows (see rows_of) in their order; the last held_out of them set the temperature."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), 1.0)
    k = len(languages)
    rows = [(ids, SCALE * n / max(n.sum(), 1) * idf[ids]) for ids, n in rows]
    y = np.array([languages.index(x) for x in labels])
    used = max(1, len(rows) - int(held_out * len(rows)))
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    one = np.array([BUCKETS])
    for _ in range(epochs):
        for r in range(used):
            ids, values = rows[r]
            ids, values = np.concatenate([ids, one]), np.append(values, 1.0)
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            p = softmax(values @ w)
            p[y[r]] -= 1
            g = values[:, None] * p[None, :]
            g2 = g * g
            z[ids] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) * alpha**-1 * w
            n[ids] = ni + g2
    w = weights(z, n)
    model = Model(languages, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], 1.0)
    if used < len(rows):
        logits = np.stack([rows[r][1] @ w[rows[r][0]] + w[-1] for r in range(used, len(rows))])
        # targets are a little below 1, as if one more text were mistaken: else texts that are all right would make it endless
        wrong = 1 / (len(logits) + 2)
        target = np.full(logits.shape, wrong / (k - 1))
        target[np.arange(len(logits)), y[used:]] = 1 - wrong
        loss = lambda t: -(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean()
        model.temperature = float(min(np.exp(np.linspace(-3, 3, 121)), key=loss))
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        # features are below 2**16; first all features, then all numbers
        found = rows_of(texts_of(b))
        rows = [pa.compress(ids.astype(np.uint16).tobytes() + n.astype(np.uint32).tobytes(), codec="zstd", asbytes=True) for ids, n in found]
        yield pa.record_batch([column(b, "key"), column(b, "label"), pa.array([len(x) for x, _ in found], pa.int32()), pa.array(rows, pa.binary())], names=["key", "label", "n", "features"])


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data, 6 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint16, n).astype(np.int64), np.frombuffer(raw, np.uint32, n, 2 * n).astype(np.int64)


def _trainer(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["key"], r["label"], r["n"], r["features"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        model = train([_unpacked(*r[2:]) for r in rows], [r[1] for r in rows], idf.value)
        there = np.flatnonzero(np.abs(model.weights).sum(axis=1))
        yield pa.record_batch({"model": pa.array([pickle.dumps((model.languages, there, model.weights[there], model.bias, model.temperature))], pa.binary())})

    return run


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", max_labelled: int = MAX_LABELLED) -> Model:
    """A model of the labelled rows among docs; inverse document frequencies are those of all docs."""
    spark = docs.sparkSession
    texts = docs.select(quoted(text_col).cast("string").alias("text"), quoted(label_col).cast("string").alias("label")).where("text is not null")
    idf = inverse_frequencies(texts.select("text"))
    # the hashes of the sample first, so that texts of those rows only are looked at; repeated texts count once
    key = F.xxhash64("text", "label")
    chosen = texts.where("label is not null").select(key.alias("key")).distinct().orderBy("key").limit(max_labelled)
    sample = texts.where("label is not null").select(key.alias("key"), "text", "label").join(F.broadcast(chosen), "key")
    featured = map_arrow(sample, _featured, "key long, label string, n int, features binary").dropDuplicates(["key"])
    found = map_arrow(featured.coalesce(1), _trainer(spark.sparkContext.broadcast(idf)), "model binary").first()
    if found is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    languages, there, w, bias, temperature = pickle.loads(found.model)
    weights = np.zeros((BUCKETS, len(languages)), np.float32)
    weights[there] = w
    return Model(languages, weights, bias, temperature)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with language and confidence."""
    made = ("language", "confidence")
    stay = [docs.schema[c] for c in others(docs, made)]
    schema = T.StructType([*stay, T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, names = carried(docs, text_col, [f.name for f in stay])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            languages, confidence = zip(*shared.value.predict(texts_of(b)), strict=True)
            yield pa.record_batch([*(column(b, c) for c in names), pa.array(languages, pa.string()), pa.array(confidence, pa.float64())], names=schema.names)

    return map_arrow(rows, run, schema)
