"""Toxic terms, misspelled ones included, weighed by what surrounds them.

The lexicon is a trie of words and of stems (which any ending may follow). A Levenshtein automaton over it - states are
sets of (trie node, edits so far) - is determinised as words ask for it; many words walk through it at once, each by one
array look-up a character. Words of four letters and fewer must be exact, and learned words and stems near which the labelled
clean texts have several other words.

A found term weighs less the more it is edited, more near a word of address, and counts as quotation inside quotation
marks or just after a word of report. Quotations alone never make a text toxic.

Terms beyond the built-in ones are learned from labelled texts: words and stems in at least so many different contexts in
toxic texts, and hardly in others. Copies of a text share their contexts, so they count once. Edited forms that the
labelled clean texts have are words of their own and don't count. max_labelled bounds the labelled texts that are read for
this; scoring covers all texts, whole.

Defined cases: null or empty text: score 0, not toxic. No labels, or no integers as labels or their ids: the built-in
lexicon alone. Labels that contradict each other: a text that any label calls toxic is. Words of fewer than four letters are
never learned, longer ones than 40 only as stems. Very long texts: whole; a longer text has more to be found in it. Ties
between terms: the heavier, then the less edited one, then by name. Repeated rows: each gets its score. Empty tables: no
rows. Other columns stay; result columns replace those of the same name, in whatever case.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import carried, column, map_arrow, others, quoted, slices, texts_of, whole_id
from stepweave.llm.textnp import Words, words

BUILT_IN = ("idiot idiots idiotic moron morons moronic imbecile imbeciles stupid scum scumbag vermin trash worthless clown loser losers pathetic disgusting bastard asshole bitch "
            "cretin dimwit dumbass jackass moronically retard subhuman shithead shitty fuck fucking fucker").split()  # fmt: skip
REPORT = frozenset("said says say wrote writes called calls word words term terms quote quoted quotes reported reportedly alleged insult slur sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein deine ihr euch tu te toi ton vous votre tú te ti usted eres are bist es".split())
WINDOW = 6
THRESHOLD = 0.5
EDIT_WEIGHT = (1.0, 0.6, 0.5)
QUOTED_MOST = 0.4
#: A quotation's marks are within so many words before and after a term (of 40 characters on average at most).
QUOTE_WORDS = 24


@dataclass
class Lexicon:
    """Weights of words and stems; own: forms that look like an edited term but are words of their own; exact: words that edits
    don't fit; loose: stems that they do fit."""

    terms: dict[str, float] = field(default_factory=lambda: dict.fromkeys(BUILT_IN, 1.0))
    stems: dict[str, float] = field(default_factory=dict)
    own: frozenset[str] = frozenset()
    exact: frozenset[str] = frozenset()
    loose: frozenset[str] = frozenset()


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2


class Matcher:
    """The automaton. State 0 is dead; accept[s] is the best (weight, edits, term) of a word that ends in s, or None."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, str, bool, int] | None] = [None]
        self.most: list[int] = [0]  # edits that some term below allows
        for stem, group in ((False, lexicon.terms), (True, lexicon.stems)):
            for term, weight in group.items():
                # a stem's end is a node of its own, reached by a mark, so that a word may share the path
                self._add(term.lower(), weight, stem)
        letters = sorted({c for node in self.children for c in node})
        self.classes = {c: i + 1 for i, c in enumerate(letters)}
        self.letters = [None, *letters]
        self.of = np.zeros(0x20001, dtype=np.int32)
        for c, i in self.classes.items():
            if ord(c) < 0x20000:
                self.of[ord(c)] = i
        self.sets: list[frozenset[tuple[int, int]]] = [frozenset()]
        self.known: dict[frozenset, int] = {frozenset(): 0}
        self.accept: list[tuple[float, int, str] | None] = [None]
        self.stem_accept: list[tuple[float, int, str] | None] = [None]
        self.next = np.full((64, len(self.letters)), -1, dtype=np.int32)
        self.next[0] = 0
        self.start = self._state(self._closed({(0, 0)}))

    def _add(self, term: str, weight: float, stem: bool) -> None:
        firm = term not in self.lexicon.loose if stem else term in self.lexicon.exact
        allowed, node = 0 if firm else edits_allowed(term), 0
        self.most[0] = max(self.most[0], allowed)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.most.append(0)
            node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed)
        if self.ends[node] is None or (stem, weight) > (self.ends[node][2], self.ends[node][0]):
            self.ends[node] = (weight, term, stem, allowed)

    def _closed(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With what deleting a letter of the term reaches; of a node only the fewest edits."""
        best: dict[int, int] = {}
        todo = sorted(states, key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, key: frozenset[tuple[int, int]]) -> int:
        if key not in self.known:
            self.known[key] = s = len(self.sets)
            self.sets.append(key)
            found = [(w * EDIT_WEIGHT[e], e, t, stem) for node, e in key if self.ends[node] for w, t, stem, allowed in [self.ends[node]] if e <= allowed]
            best = max(found, key=lambda x: (x[0], -x[1], x[2]), default=None)
            self.accept.append(best and best[:3])
            best = max((x for x in found if x[3]), key=lambda x: (x[0], -x[1], x[2]), default=None)
            self.stem_accept.append(best and best[:3])
            if s >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
        return self.known[key]

    def step(self, state: int, cls: int) -> int:
        if self.next[state, cls] < 0:
            letter, out = self.letters[cls], set()
            for node, e in self.sets[state]:
                out.add((node, e + 1))  # a letter too many
                for c, child in self.children[node].items():
                    out.add((child, e + (c != letter)))
            to = self._state(self._closed(out))
            self.next[state, cls] = to
        return int(self.next[state, cls])

    def word(self, word: str) -> tuple[float, int, str] | None:
        """The best term for one word in lower case: what find() does for many."""
        state, best = self.start, None
        for c in word:
            state = self.step(state, self.classes.get(c, 0))
            if not state:
                break
            if self.stem_accept[state] and (best is None or self.stem_accept[state] > best):
                best = self.stem_accept[state]
        if state and self.accept[state] and (best is None or self.accept[state] > best):
            best = self.accept[state]
        return None if best is None or best[1] and word in self.lexicon.own else best

    def find(self, w: Words) -> list[tuple[int, float, int, str]]:
        """(index of the word, weight, edits, term) of all words that match."""
        alive = np.arange(len(w.start))
        begin, length = w.offset[w.doc] + w.start, w.end - w.start
        state = np.full(len(alive), self.start, dtype=np.int32)
        best: dict[int, tuple[float, int, str]] = {}
        at = 0
        while len(alive):
            letter = self.of[np.minimum(w.lower[begin[alive] + at], 0x20000)]
            new = self.next[state, letter]
            if (new < 0).any():
                for k in np.unique(state[new < 0].astype(np.int64) * len(self.letters) + letter[new < 0]).tolist():
                    self.step(*divmod(k, len(self.letters)))
                new = self.next[state, letter]
            at += 1
            left = new > 0
            alive, state = alive[left], new[left]
            ended = length[alive] == at
            stems = np.array([x is not None for x in self.stem_accept])
            words_ = np.array([x is not None for x in self.accept])
            for hit, values in ((np.flatnonzero(stems[state]), self.stem_accept), (np.flatnonzero(words_[state] & ended), self.accept)):
                for h in hit.tolist():
                    i, found = int(alive[h]), values[state[h]]
                    if i not in best or found > best[i]:
                        best[i] = found
            alive, state = alive[~ended], state[~ended]
        out = []
        for i, (weight, edits, term) in sorted(best.items()):
            if not edits or self.form(w, i) not in self.lexicon.own:
                out.append((i, weight, edits, term))
        return out

    @staticmethod
    def form(w: Words, i: int) -> str:
        a = w.offset[w.doc[i]]
        return "".join(map(chr, w.lower[a + w.start[i] : a + w.end[i]].tolist()))

    def scores(self, texts: list[str | None]) -> list[tuple[float, int, int]]:
        """score, terms, terms in quotation, of each text."""
        w = words(texts)
        bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        abuse, quoted, n, nq = ([0] * len(texts) for _ in range(4))
        for i, weight, _, _ in self.find(w):
            d = int(w.doc[i])
            around = [self.form(w, j) for j in range(max(int(bounds[d]), i - WINDOW), min(int(bounds[d + 1]), i + WINDOW + 1)) if j != i]
            before = around[: i - max(int(bounds[d]), i - WINDOW)]
            n[d] += 1
            if in_quotes(texts[d], int(w.start[i]), int(w.end[i])) or any(x in REPORT for x in before[-3:]):
                nq[d] += 1
                quoted[d] += 0.3 * weight
            else:
                abuse[d] += weight * (1.25 if any(x in ADDRESS for x in around) else 1)
        return [(round(a + min(q, QUOTED_MOST), 6), x, y) for a, q, x, y in zip(abuse, quoted, n, nq, strict=True)]


_PAIRS = (("“", "”"), ("«", "»"), ("„", "“"))


def _side(before: str, after: str) -> tuple[bool, bool]:
    """Whether a straight mark between these characters may open, and may close a quotation."""
    if before.isspace() != after.isspace():
        return before.isspace(), after.isspace()
    if before.isalnum() != after.isalnum():
        return after.isalnum(), before.isalnum()
    return True, True


def in_quotes(text: str, start: int, end: int) -> bool:
    """Whether a pair of quotation marks of one line surrounds the place, both within QUOTE_WORDS words. Unpaired marks don't."""
    a, b = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    b = b if b >= 0 else len(text)
    left, right = text[max(a, start - 40 * QUOTE_WORDS) : start], text[end : min(b, end + 40 * QUOTE_WORDS)]
    if len(parts := left.rsplit(None, QUOTE_WORDS)) > QUOTE_WORDS:
        left = left[len(parts[0]) :]
    if len(parts := right.split(None, QUOTE_WORDS)) > QUOTE_WORDS:
        right = right[: len(right) - len(parts[-1])]
    if '"' in left and '"' in right:
        opened, at = -1, text.find('"', start - len(left), end + len(right))
        while at >= 0:
            opens, closes = _side(text[at - 1] if at > a else " ", text[at + 1] if at + 1 < b else " ")
            if opened >= 0 and closes:
                if opened < start and at >= end:
                    return True
                opened = -1
            elif opens:
                opened = at
            at = text.find('"', at + 1, end + len(right))
    return any(left.rfind(x) > left.rfind(y) and y in right and x not in right[: right.find(y)] for x, y in _PAIRS)


# -- learning terms --

MAX_LABELLED = 10_000
_WORD = re.compile(r"[^\W\d_]{4,}")


def _keys(word: str) -> Iterable[str]:
    """The word (unless it is very long) as '=word' and its stems as '<stem'."""
    if len(word) <= 40:
        yield "=" + word
    for k in range(4, min(8, len(word) - 1)):
        yield "<" + word[:k]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, context, word's ending of each word in toxic texts."""
    for b in batches:
        rows: set[tuple[str, int, str]] = set()
        for text in texts_of(b):
            found = [m.group() for m in _WORD.finditer((text or "").lower())]
            for i, x in enumerate(found):
                around = f"{found[i - 1] if i else ''} {found[i + 1] if i + 1 < len(found) else ''}"
                context = xxhash.xxh64_intdigest(around) - (1 << 63)
                rows.update((k, context, x[len(k) - 1 :][:4]) for k in _keys(x))
        keys, contexts, ends = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "context": pa.array(contexts, pa.int64()), "ending": pa.array(ends, pa.string())})


def _counter(candidates, matcher: Matcher):
    """In how many texts each candidate is, and the edited forms that a matcher finds, of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = candidates.value
        for b in slices(batches):
            n = {True: Counter(), False: Counter()}
            texts, toxic = texts_of(b), b.column("toxic").to_pylist()
            for text, bad in zip(texts, toxic, strict=True):
                found = {m.group() for m in _WORD.finditer((text or "").lower())}
                n[bool(bad)].update({k for x in found for k in _keys(x) if k in wanted})
                n[bool(bad)]["*"] += 1
            w = words(texts)
            forms = {(int(w.doc[i]), matcher.form(w, i)) for i, _, edits, _ in matcher.find(w) if edits}
            for d, form in forms:
                n[bool(toxic[d])]["~" + form] += 1
            keys = sorted(n[True] | n[False])
            yield pa.record_batch({"key": pa.array(keys, pa.string()), "toxic": pa.array([n[True][k] for k in keys], pa.int64()), "clean": pa.array([n[False][k] for k in keys], pa.int64())})

    return run


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, least: int = 5, share: float = 0.015, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The built-in lexicon and what the labelled documents add. labels: doc_id, toxic (0 or 1)."""
    spark = docs.sparkSession
    some = labels.select(whole_id("doc_id").alias("id"), F.col("toxic").try_cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(whole_id(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(some), "id").select("text", "toxic")  # at most max_labelled rows are broadcast
    n_toxic = some.where("toxic = 1").count()
    if not n_toxic:
        return Lexicon()
    support = max(least, int(share * n_toxic))
    seen = texts.where("toxic = 1").select("text")
    seen = map_arrow(seen, _contexts, "key string, context long, ending string")
    seen = seen.groupBy("key").agg(F.countDistinct("context").alias("contexts"), F.approx_count_distinct("ending").alias("endings")).where(F.col("contexts") >= support)
    contexts = {r.key: (r.contexts, r.endings) for r in seen.collect()}  # at most the words of toxic labelled texts / support
    lexicon = Lexicon()
    shared = spark.sparkContext.broadcast(frozenset(contexts))
    counts = map_arrow(texts, _counter(shared, Matcher(lexicon)), "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    by = {r.key: (r.toxic, r.clean) for r in counts}
    all_toxic, all_clean = by.get("*", (0, 0))
    # a term is at least a hundred times as likely in a toxic text as in a clean one, and not by chance among so many candidates
    rate = all_toxic / max(all_toxic + all_clean, 1)
    good = {k: t for k, (t, c) in by.items() if k in contexts and (c + 0.02) * max(all_toxic, 1) * 100 <= t * max(all_clean, 1) and _evidence(min(t, contexts[k][0]), c, rate) > math.log(1000 * len(contexts))}
    stems = _stems({k[1:]: contexts[k] for k in good if k[0] == "<"})
    terms = [k[1:] for k in good if k[0] == "=" and not any(k[1:].startswith(s) for s in stems) and not any(f"<{k[1:][:n]}" in stems for n in range(4, 8))]
    own = {k[1:] for k, (t, c) in by.items() if k[0] == "~" and c and c * max(all_toxic, 1) * 10 > t * max(all_clean, 1)}
    new = frozenset(terms) - set(lexicon.terms)
    found = Lexicon(lexicon.terms | dict.fromkeys(new, 1.0), dict.fromkeys(stems, 1.0), frozenset(own), loose=frozenset(stems))
    # a learned term takes edits unless clean texts have several words like it; one such word is known as its own
    like = map_arrow(texts.where("toxic = 0").select("text"), _edited(Matcher(found)), "term string, form string").distinct()
    like = like.groupBy("term").agg(F.count("*").alias("n"), F.min("form").alias("form")).collect()  # as many as there are terms
    many = {r.term for r in like if r.n > 1}
    own = found.own | {r.form for r in like if r.n == 1 and (r.term in new or r.term in stems)}
    return Lexicon(found.terms, found.stems, own, new & many, frozenset(stems) - many)


def _edited(matcher: Matcher):
    """term, form of all edited terms in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(texts_of(b))
            rows = sorted({(term, matcher.form(w, i)) for i, _, edits, term in matcher.find(w) if edits})
            terms, forms = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch({"term": pa.array(terms, pa.string()), "form": pa.array(forms, pa.string())})

    return run


def _evidence(toxic: int, clean: int, rate: float) -> float:
    """Times how unlikely such a share of toxic texts is at the given rate, as a logarithm."""
    n, p = toxic + clean, toxic / max(toxic + clean, 1)
    if p <= rate or not 0 < rate < 1:
        return 0.0
    return n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0))


def _stems(found: dict[str, tuple[int, int]]) -> list[str]:
    """Of stems that extend each other, the longest that has nearly all the contexts of the shortest; only those that several endings follow."""
    out, roots = [], defaultdict(list)
    for s in sorted(found, key=len):
        for n in range(4, len(s)):
            if s[:n] in roots:
                roots[s[:n]].append(s)
                break
        else:
            roots[s] = [s]
    for root, group in roots.items():
        best = max((s for s in group if found[s][0] >= 0.95 * found[root][0]), key=len)
        if found[best][1] >= 3:
            out.append(best)
    return sorted(out)


# -- scoring --


_MADE = (("score", T.DoubleType()), ("n_terms", T.IntegerType()), ("n_quoted", T.IntegerType()), ("toxic", T.BooleanType()))


def _scored(docs: DataFrame, lexicon: Lexicon, text_col: str, stay: list[str], drop: bool) -> DataFrame:
    """The columns stay, with scores, or, with drop, without the toxic rows."""
    made = () if drop else _MADE
    schema = T.StructType([docs.schema[c] for c in stay] + [T.StructField(n, t) for n, t in made])
    rows, names = carried(docs, text_col, stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in slices(batches):
            score, terms, quotes = (np.array(x) for x in zip(*matcher.scores(texts_of(b)), strict=True))
            toxic = score >= THRESHOLD
            if drop:
                b = b.filter(pa.array(~toxic))
            found = () if drop else (pa.array(score, pa.float64()), pa.array(terms, pa.int32()), pa.array(quotes, pa.int32()), pa.array(toxic))
            yield pa.record_batch([*(column(b, c) for c in names), *found], names=schema.names)

    return map_arrow(rows, run, schema)


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with score, n_terms, n_quoted, toxic."""
    return _scored(docs, lexicon, text_col, others(docs, [n for n, _ in _MADE]), False)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs without those that are toxic."""
    return _scored(docs, lexicon, text_col, docs.columns, True)
