"""Sanitisation of personal data by what terms disclose.

Protected entities are the personal values that texts have: mail addresses, telephone numbers, payment cards (of a known
issuer's prefix and with the right check digit), IP addresses, social security and bank account numbers. Each is
generalised to its class wherever it is. But other words can give an entity away: those that hardly ever stand anywhere
but near it. How much a term t discloses of an entity e is estimated from the corpus: the information that t gives about e
is PMI(t, e) = log2(p(t, e) / (p(t) p(e))), where p(t, e) is the share of all word places at which t stands within WINDOW
words of e; all there is to know is IC(e) = -log2 p(e). What is left unknown, IC(e) - PMI(t, e) = log2(n(t) / n(t, e)),
mustn't be less than the disclosure threshold, GENERALISE bits. A term that leaves less is generalised (a number to
[NUMBER], a capitalised word to [NAME], others to [TERM]); one that leaves less than REMOVE bits is removed.

A term counts as seen near an entity only in so many different contexts (its neighbours at either side) at least, so that
neither chance nor copies of one text make a disclosure; contexts=1 decides all terms. Counts cover all texts; places inside
entities are left out of n(t) and of n(t, e). Terms near entities are counted there, then their numbers in all texts. A
broadcast list of terms is checked in size, and joined by a shuffle beyond.

Defined cases: null text: stays null. Empty text: stays. No entities: texts stay as they are. Words of fewer than min_term
letters are no terms. Very long texts: whole. Null or repeated ids, repeated rows: each row is sanitised; ids play no part.
A term near several entities: the least that is left decides. Empty tables: no rows. Other columns stay; result columns
replace those of the same name, in whatever case.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import BROADCAST_ROWS, TEXT, column, cut, fits, map_arrow, others, quoted, slices, texts_of
from stepweave.llm.textnp import counted, words

WINDOW = 8
GENERALISE = 2.0
REMOVE = 0.4
CONTEXTS = 3
MIN_TERM = 3

_MAIL_LEFT = re.compile(r"[\w.+%-]{1,64}\Z")
_MAIL_RIGHT = re.compile(r"(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}")
_NUMBER = re.compile(r"(?<!\w)(?<!\d[.,:/-])[+(]?\d[\d ().-]{5,}\d(?!\w)|(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)")
_CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|3[47]\d{2}([ -]?)\d{6}\2\d{5}")
_ISSUER = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d+|3[47]\d{13}|(?:6011|65|64[4-9])\d+")
_KINDS = ((_CARD, "CARD"), (_IP, "IP"), (_SSN, "SSN"), (_PHONE, "PHONE"))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return not (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10


def _card(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return 13 <= len(digits) <= 19 and bool(_ISSUER.fullmatch(digits)) and (digits[0] in "43" or len(digits) in (16, 19)) and luhn(digits)


def _iban(value: str) -> bool:
    x = value.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, class, value in one form) of a text's entities, in order, none inside another."""
    out: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _MAIL_LEFT.search(text, max(0, at - 64), at), _MAIL_RIGHT.match(text, at + 1, at + 300)
        if left and right:
            begin = left.start() + len(left.group()) - len(left.group().lstrip(".%+-"))
            if begin < at:
                out.append((begin, right.end(), "EMAIL", text[begin : right.end()].lower()))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        value, begin = m.group(), m.start()
        if value[0].isalpha():
            if _iban(value):
                out.append((begin, m.end(), "ACCOUNT", value.replace(" ", "")))
            continue
        # several numbers may stand side by side
        place = 0
        while place < len(value):
            if place and (value[place - 1].isdigit() or value[place].isspace() or value[place - 1] == "."):
                place += 1
                continue
            for pattern, kind in _KINDS:
                x = pattern.match(value, place)
                if x and not (x.end() < len(value) and value[x.end()].isdigit()) and (kind != "CARD" or _card(x.group())) and not (kind == "IP" and (x.end() < len(value) and value[x.end()] == "." and value[x.end() + 1 : x.end() + 2].isdigit())):
                    out.append((begin + place, begin + x.end(), kind, re.sub(r"\D", "", x.group()) if kind != "IP" else x.group()))
                    place = x.end()
                    break
            else:
                place += 1
    kept: list[tuple[int, int, str, str]] = []
    for x in sorted(out, key=lambda x: (x[0], -x[1])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def _may_have(text: str | None) -> bool:
    return bool(text) and ("@" in text or _NUMBER.search(text) is not None)


def _terms(texts: list[str], min_term: int) -> tuple:
    """Words, and which of them are terms."""
    w = words(texts)
    return w, (w.end - w.start) >= min_term


def near(texts: list[str | None], window: int = WINDOW, min_term: int = MIN_TERM) -> list[tuple[int | None, int, int | None]]:
    """(entity, term, context) as hashes: each time that a term is near an entity; once even if it is near several mentions.

    (None, term, None): each time that a term is inside an entity.
    """
    some = [t for t in texts if _may_have(t)]
    found = [mentions(t) for t in some]
    some, found = [t for t, f in zip(some, found, strict=True) if f], [f for f in found if f]
    if not some:
        return []
    w, good = _terms(some, min_term)
    out: list[tuple[int | None, int, int | None]] = []
    for d, spans in enumerate(found):
        a, b = (int(x) for x in np.searchsorted(w.doc, [d, d + 1]))
        start, end = w.start[a:b], w.end[a:b]
        inside = np.zeros(b - a + 1, bool)
        limits = []
        for begin, stop, kind, value in spans:
            i, j = int(np.searchsorted(end, begin, side="right")), int(np.searchsorted(start, stop, side="left"))
            inside[i:j] = True
            limits.append((i, j, xxhash.xxh64_intdigest(f"{kind}:{value}") >> 1))
        out += [(None, int(w.hash[a + k]) - (1 << 63), None) for k in np.flatnonzero(inside[: b - a] & good[a:b]).tolist()]
        by: dict[int, set[int]] = defaultdict(set)
        for i, j, entity in limits:
            by[entity].update(range(max(0, i - window), i), range(j, min(b - a, j + window)))
        for entity, places in by.items():
            for k in places:
                if not inside[k] and good[a + k]:
                    left, right = (int(w.hash[a + x]) if 0 <= x < b - a and not inside[x] else 0 for x in (k - 1, k + 1))
                    out.append((entity, int(w.hash[a + k]) - (1 << 63), (left * 31 + right * 17 + 7) & ((1 << 63) - 1)))
    return out


def _near(window: int, min_term: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = near(texts_of(b), window, min_term)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["entity", "term", "context"])

    return run


def _signed(h: np.ndarray) -> np.ndarray:
    """The hashes as they are in tables."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _numbers(wanted, min_term: int):
    """How often each wanted term is in the texts; all terms if wanted is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w, good = _terms(texts_of(b), min_term)
            h = _signed(w.hash[good])
            if wanted is not None:
                known = wanted.value
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                h = h[known[at] == h]
            values, n = counted(np.sort(h))
            yield pa.record_batch({"term": pa.array(values), "n": pa.array(n.astype(np.int64))})

    return run


def disclosures(docs: DataFrame, text_col: str = "text", window: int = WINDOW, contexts: int = CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_rows: int = BROADCAST_ROWS, min_term: int = MIN_TERM) -> DataFrame:
    """term (a hash), gone (whether it goes, or else is generalised), left (bits), of the terms that disclose too much."""
    spark = docs.sparkSession
    texts = docs.select(quoted(text_col).cast("string").alias("text")).where("text is not null")
    together = map_arrow(texts, _near(window, min_term), "entity long, term long, context long")
    # copies bring the same contexts: they are counted once for support, and each time for shares
    together = cut(together.groupBy("entity", "term", "context").agg(F.count("*").alias("n")))
    pairs = together.where("entity is not null").groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts"))
    candidates = cut(pairs.where(F.col("contexts") >= contexts).groupBy("term").agg(F.max("both").alias("both")))
    if fits(candidates, broadcast_rows):
        known = np.sort(candidates.select("term").toPandas().term.to_numpy(np.int64))
        if not len(known):
            return spark.createDataFrame([], "term long, gone boolean, left double")
        numbers = map_arrow(texts, _numbers(spark.sparkContext.broadcast(known), min_term), "term long, n long")
    else:
        numbers = map_arrow(texts, _numbers(None, min_term), "term long, n long")
    inside = together.where("entity is null").select("term", (-F.col("n")).alias("n"))
    left = numbers.union(inside).groupBy("term").agg(F.sum("n").alias("n")).join(candidates, "term").select("term", F.log2(F.col("n") / F.col("both")).alias("left"))
    return left.where(F.col("left") < generalise).select("term", (F.col("left") < remove).alias("gone"), "left")


def sanitise_text(text: str, spans: list[tuple[int, int, str, str]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with entities' classes instead of them, and without or with generalised terms (begin, end, gone)."""
    changes = [(a, b, f"[{kind}]") for a, b, kind, _ in spans]
    for a, b, gone in terms:
        if not any(x <= a < y for x, y, _, _ in spans):
            word = text[a:b]
            changes.append((a, b, "" if gone else "[NUMBER]" if word.isdigit() else "[NAME]" if word[0].isupper() else "[TERM]"))
    out, at = [], 0
    for a, b, new in sorted(changes):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _sanitised(texts: list[str | None], terms: np.ndarray, gone: np.ndarray, min_term: int) -> list[tuple[str | None, int, int]]:
    """Each text sanitised, its number of entities and of terms; terms: sorted hashes as in tables."""
    places: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
    if len(terms):
        w, good = _terms(texts, min_term)
        h = _signed(w.hash)
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        for i in np.flatnonzero((terms[at] == h) & good).tolist():
            places[int(w.doc[i])].append((int(w.start[i]), int(w.end[i]), bool(gone[at[i]])))
    out = []
    for d, t in enumerate(texts):
        spans = mentions(t) if _may_have(t) else []
        mine = [x for x in places.get(d, ()) if not any(a < x[1] and x[0] < b for a, b, _, _ in spans)]
        out.append((sanitise_text(t, spans, mine) if spans or mine else t, len(spans), len(mine)))
    return out


_MADE = ("n_entities", "n_terms")


def _run(fields: list[tuple[str, str]], shared, min_term: int):
    """fields: names, and the columns or results that they are of. shared: all terms, or None where each row has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if shared is not None:
                rows = _sanitised(texts_of(b), *shared.value, min_term)
            else:
                rows = []
                for t, mine in zip(texts_of(b), column(b, "terms").to_pylist(), strict=True):
                    by = {x["term"]: x["gone"] for x in mine or ()}
                    known = np.array(sorted(by), np.int64)
                    rows += _sanitised([t], known, np.array([by[k] for k in known.tolist()], bool), min_term)
            texts, entities, terms = zip(*rows, strict=True)
            made = {TEXT: pa.array(texts, pa.string()), "n_entities": pa.array(entities, pa.int32()), "n_terms": pa.array(terms, pa.int32())}
            yield pa.record_batch([made[c] if c in made else column(b, c) for _, c in fields], names=[n for n, _ in fields])

    return run


def _terms_of(min_term: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = column(b, "key").to_numpy(zero_copy_only=False)
            w, good = _terms(texts_of(b), min_term)
            pairs = np.unique(np.stack([w.doc[good], _signed(w.hash[good])]), axis=1) if good.any() else np.zeros((2, 0), np.int64)
            yield pa.record_batch({"key": pa.array(keys[pairs[0]], pa.int64()), "term": pa.array(pairs[1], pa.int64())})

    return run


def sanitise(docs: DataFrame, text_col: str = "text", window: int = WINDOW, contexts: int = CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_rows: int = BROADCAST_ROWS, min_term: int = MIN_TERM) -> DataFrame:
    """docs with text_col sanitised, n_entities and n_terms (how many were found in the row's text)."""
    found = cut(disclosures(docs, text_col, window, contexts, generalise, remove, broadcast_rows, min_term))
    stay = others(docs, _MADE)
    fields = [(c, TEXT if c.lower() == text_col.lower() else f"c{k}") for k, c in enumerate(stay)] + [(c, c) for c in _MADE]
    schema = T.StructType([T.StructField(n, T.StringType()) if c == TEXT else T.StructField(n, T.IntegerType()) if n in _MADE else docs.schema[n] for n, c in fields])
    rows = docs.select(quoted(text_col).cast("string").alias(TEXT), *[quoted(n).alias(c) for n, c in fields[: len(stay)] if c != TEXT])
    if fits(found, broadcast_rows):
        terms = found.orderBy("term").toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((terms.term.to_numpy(np.int64), terms.gone.to_numpy(bool)))
        return map_arrow(rows, _run(fields, shared, min_term), schema)
    rows = rows.withColumn("key", F.xxhash64(TEXT))
    each = map_arrow(rows.select("key", TEXT).where(F.col(TEXT).isNotNull()), _terms_of(min_term), "key long, term long")
    each = each.distinct().join(found, "term").groupBy("key").agg(F.collect_list(F.struct("term", "gone")).alias("terms"))
    return map_arrow(rows.join(each, "key", "left"), _run(fields, None, min_term), schema)
