"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's n-grams are ordered from rare to frequent, the same way everywhere. If two texts of s and t n-grams have a
Jaccard similarity of at least T, they share at least l n-grams among the first s - ceil(T s) + l of the one and the
first t - ceil(T t) + l of the other, for every l up to ceil(T s) and ceil(T t). Each text chooses its own l: a longer
prefix brings more postings, but fewer pairs that share l of them and have to be verified; the l with the least
estimated cost wins. A pair of l and m must share min(l, m), and since a pair must have ceil(T (s + t) / (1 + T)) n-grams
in common, only shared ones count that are so near the begin of both that as many may follow: the same lemma for these two
sizes. The pairs that pass are verified on whole n-gram sets.

The order uses n-gram frequencies estimated over all texts; it decides how much work is done, never what is found.

Groups need no quadratic number of pairs: a first round pairs the texts under an n-gram with the smallest doc_id only;
a second one pairs all texts that the first one's pairs don't connect. Whose group a text is in so far is told to the tasks
by a broadcast if it fits, else by a join with the texts; the pairs are the same.

Links are counted inside groups, as nothing outside is similar: texts of equal n-gram sets are one class, each class's set
is sent to where it meets those of its group, in blocks, and every two of them are compared. So copies bring no pairs, and
no link between different texts is left out or written as a row.

Defined cases: null text, null doc_id or one that is no integer: takes no part. No words: equal to other texts of no words.
Fewer than n words: one n-gram of all of them. Very long texts: whole. Rows of the same doc_id count as one document, with
the n-grams of the row whose set's hash is first. Ties: the smallest doc_id names a group or a class. Empty tables: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stepweave.llm.common import column, cut, fits, map_arrow, quoted, semi, slices, texts_of, whole_id
from stepweave.llm.textnp import counted, distinct, mix, ngrams, words

#: Verifying a pair costs as much as so many postings.
VERIFY_COST = 20
LONGEST = 12
#: N-grams whose own frequency counts in the order; the others are rarer and have an average one.
FREQUENT = 500_000
#: N-grams that are counted together; those that are there less than three times in all such pieces count as rare.
PIECE = 2_000_000
POSTINGS_PER_BUCKET = 1_500_000
#: Verified pairs whose groups one task finds; beyond it a distributed algorithm does.
ONE_TASK_EDGES = 1_000_000
#: Texts that one task compares with the same one.
PAIRS_A_TASK = 20_000
#: Texts whose group so far is broadcast to all tasks; beyond it a join tells it.
KNOWN_GROUPED = 1_000_000
#: Classes of a group that are compared in one task with as many others.
BLOCK = 500
_48 = np.uint64((1 << 48) - 1)


def _sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unique (text << 48 | n-gram), and where each text's begin."""
    grams, doc = ngrams(words(texts), n)
    keys = distinct((doc.astype(np.uint64) << np.uint64(48)) | (grams & _48))
    return keys, np.searchsorted(keys >> np.uint64(48), np.arange(len(texts) + 1, dtype=np.uint64))


def _frequencies(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = twice = pieces = held = 0
        kept: list[np.ndarray] = []

        def piece() -> pa.RecordBatch:
            nonlocal twice, pieces, held
            every = np.concatenate([*kept, np.zeros(0, np.uint64)])
            kept.clear()
            every.sort()
            grams, counts = counted(every)
            del every
            held, pieces = 0, pieces + 1
            often = counts >= 3
            twice += int((counts == 2).sum()) * 2
            return pa.record_batch({"gram": pa.array(grams[often].astype(np.int64)), "docs": pa.array(counts[often].astype(np.int64))})

        for b in slices(batches):
            keys, _ = _sets(texts_of(b), n)
            kept.append(keys & _48)
            total, held = total + len(keys), held + len(keys)
            if held >= PIECE:
                yield piece()
        if kept:
            yield piece()
        yield pa.record_batch({"gram": pa.array([-1, -2, -3], pa.int64()), "docs": pa.array([total, twice, pieces], pa.int64())})

    return run


def _choose(sizes: np.ndarray, bounds: np.ndarray, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's l and its prefix's length. others: how many other texts have each of the n-grams in order, as estimated."""
    need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    total = np.concatenate([[0.0], np.cumsum(others)])
    begin, best, ell = bounds[:-1], np.full(len(sizes), np.inf), np.ones(len(sizes), dtype=np.int64)
    for l in range(1, LONGEST + 1):
        length = np.minimum(sizes - need + l, sizes)
        hits = total[begin + length] - total[begin]
        cost = hits + VERIFY_COST * hits / l
        better = (cost < best * 0.999) & (l <= need)
        best, ell = np.where(better, cost, best), np.where(better, l, ell)
    return ell, np.minimum(sizes - need + ell, sizes)


#: What a row of postings holds, and how wide each number is.
_PARTS = (("token", np.uint32), ("doc", np.uint16), ("place", np.uint16), ("ids", np.int64), ("sizes", np.int32), ("ells", np.uint8), ("labels", np.int64))


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of _PARTS compressed; first bytes of all numbers stand together, then second bytes, and so on; ids as differences."""
    parts = []
    for name, kind in _PARTS:
        x = arrays[name].astype(kind)
        if name in ("ids", "labels"):
            x = np.diff(x, prepend=0)
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _unpacked(row: dict) -> dict[str, np.ndarray]:
    """Of a row with data, and the numbers of tokens, documents and labels."""
    many = {"token": row["tokens"], "doc": row["tokens"], "place": row["tokens"], "labels": row["labelled"]}
    sizes = [(name, kind, many.get(name, row["docs"])) for name, kind in _PARTS]
    raw = np.frombuffer(pa.decompress(row["data"], sum(n * np.dtype(k).itemsize for _, k, n in sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for name, kind, n in sizes:
        width = np.dtype(kind).itemsize
        x = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel()
        out[name], at = np.cumsum(x) if name in ("ids", "labels") else x, at + n * width
    return out


def _prefixes(n: int, threshold: float, frequent, buckets: int, labelled: bool = False):
    """Postings by bucket. labelled: rows have a label (their group so far, or null), which goes with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, freqs, rare = frequent.value  # n-grams in order, and how many other texts have each, or one that isn't there
        # equal frequencies have one rank; there are 65,535 at most, in steps that are even where frequencies are low
        levels = np.unique(freqs)
        rank = (np.searchsorted(levels, freqs) * min(1.0, 65534 / max(len(levels), 1))).astype(np.uint64) + np.uint64(1)
        for b in slices(batches):
            ids = column(b, "id").to_numpy(zero_copy_only=False)
            labels = pc.coalesce(column(b, "label"), column(b, "id")).to_numpy(zero_copy_only=False) if labelled else None
            keys, bounds = _sets(texts_of(b), n)
            gram, doc = keys & _48, keys >> np.uint64(48)
            freq, order = np.full(len(gram), rare), np.zeros(len(gram), dtype=np.uint64)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                known = grams[at] == gram
                freq[known], order[known] = freqs[at[known]], rank[at[known]]
            perm = np.argsort((doc << np.uint64(48)) | (order << np.uint64(32)) | (gram >> np.uint64(16)), kind="stable")
            gram, doc, freq = gram[perm], doc[perm].astype(np.int64), freq[perm]
            sizes = np.diff(bounds)
            ell, length = _choose(sizes, bounds, freq, threshold)
            place = np.arange(len(gram)) - bounds[doc]
            take = place < length[doc]
            gram, doc, place = gram[take], doc[take], place[take]
            place = place * 65535 // np.maximum(sizes[doc], 65535)  # of texts of more n-grams rounded down
            bucket, token = (gram % np.uint64(buckets)).astype(np.int64), ((gram // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            perm = np.argsort(bucket, kind="stable")
            bucket, token, doc, place = bucket[perm], token[perm], doc[perm], place[perm].astype(np.uint16)
            there, many = counted(bucket)
            firsts = np.cumsum(many) - many
            rows = []
            for i, j in zip(firsts, [*firsts[1:], len(bucket)], strict=True):
                docs, many = counted(doc[i:j])
                own = labels[docs] if labelled else ids[:0]
                data = {"token": token[i:j], "doc": np.repeat(np.arange(len(docs)), many), "place": place[i:j], "ids": ids[docs], "sizes": sizes[docs], "ells": ell[docs], "labels": own}
                rows.append((j - i, len(docs), len(own), _packed(data)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(there.astype(np.int32)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True))], names=["bucket", "tokens", "docs", "labelled", "data"])

    return run


def _pairs(left: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each i with the left[i] positions after it, a bounded number at a time."""
    total = np.cumsum(left)
    begin = 0
    while begin < len(left):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, side="right")))
        n = left[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        starts = np.cumsum(n) - n
        yield i, i + 1 + np.arange(len(i)) - np.repeat(starts, n)
        begin = end


def _candidates(threshold: float, star: bool, labels):
    """Of each bucket: pairs with the n-grams that they share there. star: with the smallest doc_id only; else those of different labels.

    labels: documents and their labels, or None where the postings have them.
    """

    share = threshold / (1 + threshold)

    def bucket(rows: list[dict]) -> pa.RecordBatch | None:
        parts = [_unpacked(r) for r in rows]
        firsts = np.cumsum([0] + [len(x["ids"]) for x in parts[:-1]])
        doc = np.concatenate([x["doc"].astype(np.int64) + f for x, f in zip(parts, firsts, strict=True)])
        ids, sizes, ells, token, place, told = (np.concatenate([x[k] for x in parts]) for k in ("ids", "sizes", "ells", "token", "place", "labels"))
        del parts
        place = place.astype(np.int64)
        order = np.lexsort((sizes, ids)) if star else np.lexsort((ids, sizes))
        rank = np.empty(len(ids), dtype=np.uint64)
        rank[order] = np.arange(len(ids), dtype=np.uint64)
        ids, sizes, ells = ids[order], sizes[order], ells[order]
        keys = (token.astype(np.uint64) << np.uint64(32)) | rank[doc]
        perm = np.argsort(keys)
        keys = keys[perm]
        token, doc = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = place[perm] * np.maximum(sizes[doc], 65535) // 65535
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.concatenate([first, [len(token)]]))
        found: dict[str, np.ndarray] = {"k": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}

        def add(i: np.ndarray, j: np.ndarray) -> None:
            a, b = doc[i], doc[j]
            s, t = sizes[a].astype(np.int64), sizes[b].astype(np.int64)
            spare = np.minimum(ells[a], ells[b]) - np.ceil(share * (s + t) - 1e-9).astype(np.int64)
            fit = (place[i] < s + spare) & (place[j] < t + spare) & (np.minimum(s, t) >= threshold * np.maximum(s, t) - 1e-9) & (ids[a] != ids[b])
            k, n = counted(np.sort((a[fit].astype(np.uint64) << np.uint64(32)) | b[fit].astype(np.uint64)))
            if len(found["k"]):
                k, n = np.concatenate([found["k"], k]), np.concatenate([found["n"], n])
                order = np.argsort(k, kind="stable")
                k, n = k[order], n[order]
                firsts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
                k, n = k[firsts], np.add.reduceat(n, firsts) if len(k) else n
            found["k"], found["n"] = k, n

        keep = count > 1
        if star:
            first, count = first[keep], count[keep]
            pivot = np.repeat(first, count - 1)
            other = pivot + 1 + (np.arange(len(pivot)) - np.repeat(np.cumsum(count - 1) - (count - 1), count - 1))
            add(pivot, other)
        else:
            label = ids.copy()
            if labels is None:
                label = told[order]
            elif len(known := labels.value[0]):
                to = labels.value[1]
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                hit = known[at] == ids
                label[hit] = to[at[hit]]
            of = label[doc]
            keep &= np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
            mine = np.repeat(keep, count)
            doc, place, of = doc[mine], place[mine], of[mine]
            # a run's texts go by size: partners are those after a text up to the largest that its size and place allow
            s, run = sizes[doc].astype(np.int64), np.repeat(np.arange(int(keep.sum())), count[keep]) << 32
            most = np.minimum(s / threshold, (s + ells[doc] - place - 1) / share - s + 1e-6)
            left = np.searchsorted(run | s, run | np.floor(np.maximum(most, 0) + 1e-6).astype(np.int64), side="right") - np.arange(len(s)) - 1
            for i, j in _pairs(np.maximum(left, 0)):
                other = of[i] != of[j]
                add(i[other], j[other])
        if not len(found["k"]):
            return None
        a, b = (found["k"] >> np.uint64(32)).astype(np.int64), (found["k"] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return pa.record_batch({"a": pa.array(np.minimum(ids[a], ids[b])), "b": pa.array(np.maximum(ids[a], ids[b])), "hits": pa.array(found["n"]), "need": pa.array(np.minimum(ells[a], ells[b]).astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                by.setdefault(r["bucket"], []).append(r)
        for k in list(by):
            if (found := bucket(by.pop(k))) is not None:
                yield found

    return run


def _hashes(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each text's set (big-endian bytes), whatever its order; no set is empty."""
    both = [np.add.reduceat(mix((keys & _48) ^ np.uint64(x)), bounds[:-1]) + np.diff(bounds).astype(np.uint64) for x in (0x5BD1E995 << 20, 0x1B873593 << 24)] if len(keys) else [np.zeros(0, np.uint64)] * 2
    return np.stack(both, axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)


def _gram_sets(n: int, keep: list[str], grams: bool = True):
    """The columns keep, and grams: each text's set as its hash, then six bytes for each n-gram in order, if grams are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, bounds = _sets(texts_of(b), n)
            hashes = _hashes(keys, bounds)
            six = (keys & _48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6] if grams else None
            sets = [h.tobytes() + (six[i:j].tobytes() if grams else b"") for h, i, j in zip(hashes, bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([*(column(b, c) for c in keep), pa.array(sets, pa.binary())], names=[*keep, "grams"])

    return run


def _set_of(x: pa.Scalar) -> np.ndarray:
    six = np.frombuffer(x.as_buffer(), np.uint8)[16:].reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by a and salt, the set of a itself first; repeated rows of a document count as the first."""
    key, own, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        out: list[tuple[int, int, float]] = []
        ids, sets = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "grams"))
        for a, salt, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids.to_pylist(), sets, strict=True):
            if (a, salt, i) == last:
                continue
            last, x = (a, salt, i), _set_of(x)
            if (a, salt) != key:
                key, own = (a, salt), x
                continue
            both = len(own) + len(x) - len(distinct(np.sort(np.concatenate([own, x]))))
            out.append((a, i, both / (len(own) + len(x) - both)))
        columns = list(zip(*out, strict=True)) if out else ([], [], [])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "jaccard"])


def _verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a < b) that are similar. A set is sent to each a that it is compared with, and no further."""
    pairs = cut(pairs.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need").select("a", "b"))
    salts = pairs.groupBy("a").agg((F.count("*") / PAIRS_A_TASK).cast("int").alias("most"))
    compared = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("most") + 1).cast("int").alias("salt"), F.col("b").alias("id"))
    own = compared.select("a", "salt").distinct().withColumn("id", F.col("a"))
    asked = cut(compared.union(own))
    texts = docs.join(F.broadcast(asked) if fits(asked) else asked, "id").select("a", "salt", "id", "text")
    sets = map_arrow(texts, _gram_sets(n, ["a", "salt", "id"]), "a long, salt int, id long, grams binary").repartition("a", "salt").sortWithinPartitions("a", "salt", "id", "grams")
    return cut(map_arrow(sets, _jaccard, "a long, b long, jaccard double").where(F.col("jaccard") >= threshold - 1e-12))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = sorted(parent)
    yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "group_id": pa.array([root(x) for x in ids], pa.int64())})


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """doc_id, group_id (the smallest doc_id that it is connected with) of the documents in edges (a, b)."""
    if fits(edges, one_task):
        return map_arrow(edges.select("a", "b").coalesce(1), _union, "doc_id long, group_id long")
    links = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(links.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.col("doc_id")).alias("group_id")))
    while True:
        near = links.join(labels, links.b == labels.doc_id).select(F.col("a").alias("doc_id"), "group_id").union(labels).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
        to = labels.select(F.col("doc_id").alias("group_id"), F.col("group_id").alias("further"))
        new = cut(near.join(to, "group_id").select("doc_id", F.least("group_id", "further").alias("group_id")))
        if new.join(labels, ["doc_id", "group_id"], "left_anti").isEmpty():
            return new
        labels = new


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(whole_id(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where("id is not null and text is not null")


def jaccard_edges(docs: DataFrame, n: int = 2, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", all_pairs: bool = False, known_grouped: int = KNOWN_GROUPED) -> DataFrame:
    """a, b (a < b), jaccard: similar pairs. Unless all_pairs, only as many as connect each group of similar texts."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be above 0 and at most 1, n at least 1")
    spark = docs.sparkSession
    docs = _inputs(docs, id_col, text_col)
    counts = map_arrow(docs.select("text"), _frequencies(n), "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    counts = cut(counts)
    # the least frequency that counts, so that no task or driver has to sort n-grams; rows of one number each
    by_docs = counts.where("gram >= 0").groupBy("docs").agg(F.count("*").alias("n")).orderBy(F.desc("docs")).withColumn("upto", F.sum("n").over(W.orderBy(F.desc("docs"))))
    least = by_docs.where(F.col("upto") <= FREQUENT).agg(F.min("docs")).first()[0] or 1 << 62
    top = counts.where((F.col("gram") < 0) | (F.col("docs") >= least)).toArrow().to_pandas()
    total, twice, pieces = (int(top.loc[top.gram == k, "docs"].sum()) for k in (-1, -2, -3))
    top = top[top.gram >= 0].sort_values("gram")
    rare = twice / max(total, 1) * pieces + 1e-6  # the chance to meet in one piece of the texts, over all pieces
    buckets = max(1, math.ceil(total * min(1.0, 1 - threshold + 0.02) / POSTINGS_PER_BUCKET))
    frequent = spark.sparkContext.broadcast((top.gram.to_numpy(np.uint64), top.docs.to_numpy(np.float64) - 1, rare))
    schema = "bucket int, tokens int, docs int, labelled int, data binary"
    postings = cut(map_arrow(docs, _prefixes(n, threshold, frequent, buckets), schema).repartitionById(buckets, "bucket"))
    pair_schema = "a long, b long, hits long, need int"
    if all_pairs:
        none = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return _verified(docs, map_arrow(postings, _candidates(threshold, False, none), pair_schema), n, threshold)
    stars = _verified(docs, map_arrow(postings, _candidates(threshold, True, None), pair_schema), n, threshold)
    labels = cut(components(stars))
    if fits(labels, known_grouped):
        known = labels.toArrow().to_pandas().sort_values("doc_id")
        labelled = spark.sparkContext.broadcast((known.doc_id.to_numpy(np.int64), known.group_id.to_numpy(np.int64)))
    else:
        texts = docs.join(labels.select(F.col("doc_id").alias("id"), F.col("group_id").alias("label")), "id", "left").select("id", "label", "text")
        postings = cut(map_arrow(texts, _prefixes(n, threshold, frequent, buckets, True), schema).repartitionById(buckets, "bucket"))
        labelled = None
    rest = _verified(docs, map_arrow(postings, _candidates(threshold, False, labelled), pair_schema), n, threshold)
    return stars.union(rest)


def _links(threshold: float):
    """Rows come by group, x and y (blocks), with the block of each set: how many of the others of x and y each is similar to."""

    def links(ids: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sets])
        doc, grams = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        grams, doc = grams[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        many = np.diff(np.append(first, len(grams)))
        begin, count = np.repeat(first, many), np.repeat(many, many)
        by_doc = np.argsort(doc, kind="stable")
        ends = np.cumsum(sizes)
        out = np.zeros(len(sets), np.int64)
        for k in range(len(sets)):
            if blocks[k] != x:
                continue  # its pairs are those of the others
            mine = by_doc[ends[k] - sizes[k] : ends[k]]
            b, c = begin[mine], count[mine]
            at = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(b, c)
            both = np.bincount(doc[at], minlength=len(sets))
            similar = (both / (sizes + sizes[k] - both) >= threshold - 1e-12) & (blocks == y)
            similar[k] = False
            out[k] += similar.sum()
            if x != y:
                out += similar
        return ids[out > 0], out[out > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                found = links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], key[1], key[2])
                yield pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["class_id", "n_links"])

        for b in batches:
            for g, x, y, i, block, s in zip(*(column(b, c).to_pylist() for c in ("group_id", "x", "y", "id", "block")), column(b, "grams"), strict=True):
                if (g, x, y) != key:
                    yield from done()
                    key, rows = (g, x, y), []
                rows.append((i, block, _set_of(s)))
        yield from done()

    return run


def count_links(docs: DataFrame, groups: DataFrame, n: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """doc_id, group_id, class_id (the smallest doc_id of its n-gram set), n_links (other classes that its class is similar to).

    docs: id, text; groups: doc_id, group_id, of all documents that are similar to another.
    """
    told = groups.select(F.col("doc_id").alias("id"), "group_id")
    texts = docs.join(F.broadcast(told) if fits(told) else told, "id").select("group_id", "id", "text")
    hashes = map_arrow(texts, _gram_sets(n, ["group_id", "id"], grams=False), "group_id long, id long, grams binary")
    hashes = cut(hashes.groupBy("group_id", "id").agg(F.min("grams").alias("h")))
    classes = cut(hashes.groupBy("group_id", "h").agg(F.min("id").alias("class_id")))
    # two classes of one group are similar to each other; more are compared, each in blocks of its group's classes
    many = classes.groupBy("group_id").agg(F.count("*").alias("classes"))
    blocks = classes.join(many.where("classes > 2"), "group_id").withColumn("blocks", F.ceil(F.col("classes") / block).cast("int"))
    blocks = cut(blocks.select(F.col("class_id").alias("id"), "group_id", "h", "blocks"))
    sets = map_arrow(docs.join(F.broadcast(blocks) if fits(blocks) else blocks, "id").select("group_id", "id", "h", "blocks", "text"), _gram_sets(n, ["group_id", "id", "h", "blocks"]), "group_id long, id long, h binary, blocks int, grams binary")
    sets = sets.where(F.substring("grams", 1, 16) == F.col("h")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    sent = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group_id", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", "grams")
    sent = sent.repartition("group_id", "x", "y").sortWithinPartitions("group_id", "x", "y", "id")
    links = map_arrow(sent, _links(threshold), "class_id long, n_links long").groupBy("class_id").agg(F.sum("n_links").alias("n_links"))
    links = links.union(classes.join(many.where("classes = 2"), "group_id").select("class_id", F.lit(1).cast("long")))
    told = classes.join(links, "class_id", "left").select("group_id", "h", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return hashes.join(told, ["group_id", "h"]).select(F.col("id").alias("doc_id"), "group_id", "class_id", "n_links")


def _groups(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, known_grouped: int = KNOWN_GROUPED) -> DataFrame:
    return cut(components(jaccard_edges(docs, n, threshold, id_col, text_col, known_grouped=known_grouped)))


def near_duplicate_groups(docs: DataFrame, n: int = 2, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", known_grouped: int = KNOWN_GROUPED, block: int = BLOCK) -> DataFrame:
    """doc_id, group_id, group_size, class_id, n_links: of each document that is similar to another, directly or over others.

    group_id: the smallest doc_id in the group. class_id: the smallest doc_id with the same n-grams. n_links: how many other
    classes are similar to it.
    """
    groups = _groups(docs, n, threshold, id_col, text_col, known_grouped)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("group_size"))
    each = count_links(_inputs(docs, id_col, text_col), groups, n, threshold, block)
    return each.join(sizes, "group_id").select("doc_id", "group_id", "group_size", "class_id", "n_links")


def drop_near_duplicates(docs: DataFrame, n: int = 2, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of a group but that with the smallest doc_id, all rows of it. Rows of null doc_id or text stay."""
    gone = _groups(docs, n, threshold, id_col, text_col).where("doc_id <> group_id").select("doc_id")
    return semi(docs, gone, id_col, "left_anti")
