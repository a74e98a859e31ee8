"""Benchmark decontamination over a positional inverted index of the training documents.

The index is stored in segments of a few hundred documents: for every test term that is there its places, as lists sorted by
document and position. (Terms that no test item has need no postings.) A segment holds whole documents, so that lists are
intersected inside it and nothing is shuffled. Term counts over all segments give the order: a phrase's search begins with
the places of its rarest term, shifted by the term's offset in the phrase, and keeps those that the next rarer terms'
lists have as well, shifted likewise.

Exact matches: any phrase_words consecutive words of an item (all of them if it has fewer). Proximity matches: at least
three quarters of an item's rarest terms, at least three of them, within one and a half times the item's length; this
finds passages with words changed, added or moved. Each pair of item and document is returned once, with the first place
(of phrases, else of those with the most terms).

Defined cases: null text, null id or one that is no integer, on either side: takes no part. Items of fewer than min_words
words have exact matches only, of the whole item; drop_contaminated passes these over, as they would match by chance. Items
or texts without words take no part. Very long texts: whole, in one segment. Ties: of equally rare terms those that come
first in the item count as rarer. Repeated items or rows: once. No items or no documents: no matches. Other columns are
ignored, or kept by drop_contaminated, in which rows of null doc_id stay and all rows of a repeated doc_id that matches go.
The items are read to the driver, slice by slice if they are many, never the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import column, cut, map_arrow, quoted, semi, slices, texts_of, whole_id
from stepweave.llm.textnp import counted, distinct, words

PHRASE_WORDS = 13
MIN_WORDS = 5
RAREST = 8
SHARE = 0.75
SPREAD = 1.5
#: Characters of items whose words are indexed at once; more make more rounds over the documents.
ITEM_CHARS = 5_000_000
#: Of these, characters of items that are searched at once; more make more rounds over the index.
SEARCH_CHARS = 1_000_000
_SCHEMA = "ids binary, terms binary, counts binary, docs binary, places binary"
_FOUND = "item_id long, doc_id long, kind string, place int, n_words int"


def _index(vocabulary):
    """A row for each segment: its doc_ids; the terms that are there and how often, and the postings, by term, document, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in slices(batches):
            ids = column(b, "id").to_numpy(zero_copy_only=False).astype(np.int64)
            w = words(texts_of(b))
            first = np.searchsorted(w.doc, np.arange(len(ids)))
            place = np.arange(len(w.doc)) - first[w.doc] if len(w.doc) else w.doc
            at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
            hit = np.flatnonzero(known[at] == w.hash)
            order = hit[np.argsort(at[hit], kind="stable")]
            terms, counts = counted(at[order])
            arrays = (("ids", ids), ("terms", terms.astype(np.int32)), ("counts", counts.astype(np.int32)), ("docs", w.doc[order].astype(np.uint16)), ("places", place[order].astype(np.int32)))
            yield pa.record_batch({k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays})

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for terms, counts in zip(column(b, "terms"), column(b, "counts"), strict=True):
            yield pa.record_batch({"term": pa.array(np.frombuffer(terms.as_buffer(), np.int32).astype(np.int64)), "n": pa.array(np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64))})


def _expand(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, and begin, begin + 1, ... of each."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]


def _matching(present: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of an index into present and one into keys (sorted) of equal values."""
    low = np.searchsorted(keys, present, side="left")
    return _expand(low, np.searchsorted(keys, present, side="right") - low)


@dataclass
class _Segment:
    present: np.ndarray  # terms
    begin: np.ndarray  # where each one's list begins, and the last ends
    key: np.ndarray  # document << 32 | place

    @classmethod
    def of(cls, row: dict) -> _Segment:
        counts = np.frombuffer(row["counts"], np.int32)
        key = (np.frombuffer(row["docs"], np.uint16).astype(np.int64) << 32) | np.frombuffer(row["places"], np.int32).astype(np.int64)
        return cls(np.frombuffer(row["terms"], np.int32).astype(np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), key)


class _Search:
    """All phrases and items against one segment at a time. totals: how often each term is in all segments."""

    def __init__(self, items: list[np.ndarray], totals: np.ndarray, phrase_words: int, near_words: int = 0):
        sizes = np.array([len(x) for x in items], np.int64)
        every = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)
        firsts = np.cumsum(sizes) - sizes
        length = np.minimum(sizes, phrase_words)
        owner, at = _expand(firsts, np.where(sizes > 0, sizes - length + 1, 0))
        width = int(length.max(initial=1))
        inside = np.arange(width)[None, :] < length[owner][:, None]
        terms = np.where(inside, every[np.minimum(at[:, None] + np.arange(width), max(len(every) - 1, 0))] if len(every) else 0, -1)
        rarity = np.where(inside, totals[np.maximum(terms, 0)] if len(totals) else 0, np.iinfo(np.int64).max)
        offsets = np.argsort(rarity, axis=1, kind="stable")
        rows = np.flatnonzero(np.take_along_axis(rarity, offsets[:, :1], axis=1)[:, 0] > 0) if len(offsets) else np.zeros(0, np.int64)  # else no document has it
        terms, offsets, owner = np.take_along_axis(terms, offsets, axis=1)[rows], offsets[rows], owner[rows]
        order = np.argsort(terms[:, 0], kind="stable")
        self.terms, self.offsets, self.owners = terms[order].astype(np.int32), offsets[order].astype(np.int16), owner[order]
        self.lengths = length[self.owners]
        slots = []
        self.need, self.span = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        for k, item in enumerate(items):
            if len(item) < near_words:
                continue
            rare = sorted(dict.fromkeys(item.tolist()), key=lambda t: totals[t])[:RAREST]
            self.need[k], self.span[k] = max(3, math.ceil(SHARE * len(rare))), math.ceil(SPREAD * len(item))
            if sum(totals[t] > 0 for t in rare) >= self.need[k]:
                slots += [(t, k, s) for s, t in enumerate(rare) if totals[t]]
        slots.sort()
        self.slots = np.array(slots, np.int64).reshape(-1, 3)

    def phrases(self, x: _Segment) -> list[tuple[int, int, int]]:
        """(item, document << 32 | place, words) of the windows that match."""
        if not len(self.terms) or not len(x.key):
            return []
        rank, row = _matching(x.present, self.terms[:, 0])
        each, at = _expand(x.begin[rank], x.begin[rank + 1] - x.begin[rank])
        row, place, key = row[each], x.key & 0xFFFFFFFF, x.key[at]
        ok = (key & 0xFFFFFFFF) >= self.offsets[row, 0]
        row, begin = row[ok], key[ok] - self.offsets[row[ok], 0]
        # (term, document) by its rank, so that rank and place fit into 64 bits, however many terms there are
        lists = (np.repeat(np.arange(len(x.present)), np.diff(x.begin)) << 16) | (x.key >> 32)
        pairs, many = counted(lists)
        sought = (np.repeat(np.arange(len(pairs)), many) << 32) | place
        for k in range(1, self.terms.shape[1]):
            if not len(row):
                break
            term = self.terms[row, k].astype(np.int64)
            at = np.minimum(np.searchsorted(x.present, term), len(x.present) - 1)
            pair = (at << 16) | (begin >> 32)
            rank = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            target = (rank << 32) + (begin & 0xFFFFFFFF) + self.offsets[row, k]
            found = np.minimum(np.searchsorted(sought, target), len(sought) - 1)
            ok = (term < 0) | ((x.present[at] == term) & (pairs[rank] == pair) & (sought[found] == target))
            row, begin = row[ok], begin[ok]
        # of an item only the first place in each document: items of a few words may be at very many
        order = np.lexsort((begin, self.owners[row]))
        row, begin = row[order], begin[order]
        owner, doc = self.owners[row], begin >> 32
        first = np.ones(len(row), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
        row, begin = row[first], begin[first]
        return list(zip(self.owners[row].tolist(), begin.tolist(), self.lengths[row].tolist(), strict=True))

    def near(self, x: _Segment) -> list[tuple[int, int, int]]:
        """(item, document << 32 | place, terms) where enough of the item's rarest terms are close together."""
        if not len(self.slots) or not len(x.key):
            return []
        rank, which = _matching(x.present, self.slots[:, 0])
        row, at = _expand(x.begin[rank], x.begin[rank + 1] - x.begin[rank])
        if not len(row):
            return []
        item, slot, where = self.slots[which[row], 1], self.slots[which[row], 2], x.key[at]
        group = (item << 16) | (where >> 32)
        # only pairs of item and document that have enough of the terms at all
        pairs, _ = counted(np.sort((group << 3) | slot))
        pairs, many = counted(pairs >> 3)
        good = pairs[many >= self.need[pairs >> 16]]
        if not len(good):
            return []
        rank = np.minimum(np.searchsorted(good, group), len(good) - 1)
        keep = good[rank] == group
        rank, where, slot, item = rank[keep], where[keep], slot[keep], item[keep]
        line = (rank << 32) | (where & 0xFFFFFFFF)
        order = np.argsort(line, kind="stable")
        line, slot, item, where = line[order], slot[order], item[order], where[order]
        end = np.searchsorted(line, line + self.span[item], side="left")
        end = np.minimum(end, np.searchsorted(line, ((line >> 32) + 1) << 32, side="left"))
        begin, n = np.arange(len(line)), np.zeros(len(line), np.int64)
        for s in range(RAREST):
            seen = np.concatenate([[0], np.cumsum(slot == s)])
            n += seen[end] > seen[begin]
        hit = n >= self.need[item]
        return list(zip(item[hit].tolist(), where[hit].tolist(), n[hit].tolist(), strict=True))


def _matches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, search = shared.value
        for b in batches:
            for r in b.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), _Segment.of(r)
                out: dict[tuple[int, int], tuple[str, int, int]] = {}
                for kind, found in (("phrase", search.phrases(x)), ("proximity", search.near(x))):
                    for item, where, n in found:
                        pair, new = (item_ids[item], int(ids[where >> 32])), (kind, where & 0xFFFFFFFF, n)
                        old = out.get(pair)
                        if old is None or (new[0], -new[2], new[1]) < (old[0], -old[2], old[1]):
                            out[pair] = new
                rows = [(i, d, *x) for (i, d), x in sorted(out.items())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.record_batch({n: pa.array(c, t) for n, c, t in zip(("item_id", "doc_id", "kind", "place", "n_words"), columns, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)})

    return run


def _parts(sizes: np.ndarray, most: int) -> list[slice]:
    """Runs of items of so many characters at most, one item at least."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            out.append(slice(begin, i))
            begin, total = i, 0
        total += n
    return [*out, slice(begin, len(sizes))] if len(sizes) else []


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS, phrase_min_words: int = 1, search_chars: int = SEARCH_CHARS) -> DataFrame:
    """item_id, doc_id, kind (phrase or proximity), place (in words), n_words (matched at least there).

    Items of fewer than min_words words have phrase matches only, those of fewer than phrase_min_words none."""
    spark = docs.sparkSession
    rows = docs.select(whole_id(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    tests = benchmark.select(whole_id(item_col).alias("item"), quoted(item_text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, math.ceil(chars / item_chars))
    out = spark.createDataFrame([], _FOUND)
    for k in range(rounds):
        part = tests.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == k).toPandas() if rounds > 1 else tests.toPandas()
        part = part.sort_values(["item", "text"])
        w = words(part.text.tolist())
        bounds = np.searchsorted(w.doc, np.arange(len(part) + 1))
        sizes, lengths = np.diff(bounds), part.text.str.len().to_numpy()
        kept = np.flatnonzero(sizes >= max(1, min(min_words, phrase_min_words)))
        if not len(kept):
            continue
        vocabulary = distinct(np.concatenate([w.hash[bounds[i] : bounds[i + 1]] for i in kept]))
        segments = cut(map_arrow(rows, _index(spark.sparkContext.broadcast(vocabulary)), _SCHEMA))
        found = map_arrow(segments.select("terms", "counts"), _totals, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        totals = np.zeros(len(vocabulary), np.int64)
        totals[found.term.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
        ids = part["item"].tolist()
        for run in _parts(lengths[kept], search_chars):
            items = [np.searchsorted(vocabulary, w.hash[bounds[i] : bounds[i + 1]]) for i in kept[run]]
            search = spark.sparkContext.broadcast(([int(ids[i]) for i in kept[run]], _Search(items, totals, phrase_words, min_words)))
            out = out.union(map_arrow(segments, _matches(search), _FOUND))
    # an item of several texts, or a document of several rows, may match more than once
    best = F.min(F.struct("kind", (-F.col("n_words")).alias("less"), "place"))
    return out.groupBy("item_id", "doc_id").agg(best.alias("b")).select("item_id", "doc_id", "b.kind", "b.place", (-F.col("b.less")).alias("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that match an item of min_words words or more."""
    found = benchmark_matches(docs, benchmark, phrase_words, min_words, id_col, text_col, phrase_min_words=min_words)
    return semi(docs, cut(found.select("doc_id").distinct()), id_col, "left_anti")
