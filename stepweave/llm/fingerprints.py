"""Merkle trees of documents: paragraphs, sections, the whole.

A text's sections are parted by blank lines, a section's paragraphs by line ends. A leaf is the hash of a paragraph, a
section's node that of its leaves, the root that of its sections' nodes; leaves and inner nodes are hashed with different
first bytes, so that no text passes for a tree. Equal roots mean equal texts (white space at the ends of paragraphs and
blank lines aside). Where roots differ, equal branches are passed over and only differing ones are gone down into, to the
paragraphs that were changed. Trees are made once, and written; below the root they keep 64 bits of each hash.

A document is compared with the earlier one (smaller id) that has most of its paragraphs, of all there are; a base must have
at least min_share of them. Pairs are made below paragraphs that are in a few documents only, and only below those of a
document's rarest paragraphs without which a base couldn't have enough of the others. Paragraphs in more documents than that
are looked at afterwards: what documents have of those is the same for very many, so each different set of them counts as
one document, the first that has it, and all is done again for these sets, among which a paragraph is in far fewer. So no
paragraph brings more pairs than a bounded number for each document that has it, and no pair is left out.

Defined cases: null id, or one that is no integer: takes no part. Null text: null root, no sections. Empty or blank text: no
sections, the root of none; such texts are equal. Very long texts: whole, one tree each. Paragraphs of fewer than min_chars
characters don't tell where a document comes from; a document of such ones only has no base. Several earlier documents with
as many paragraphs: the smallest id is the base. Repeated rows: one each; rows of one id with different texts are compared
with others each, not with each other. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import cut, fits, quoted, semi, whole_id

#: Paragraphs of fewer characters don't tell which document another comes from.
MIN_CHARS = 20
#: A document counts as an edit of another that has at least this share of its telling paragraphs.
MIN_SHARE = 0.5
#: Paragraphs in more documents (or different sets of paragraphs) than this are left to the next round.
PAIRED = 64


def _hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def _paragraphs(section: Column) -> Column:
    return F.filter(F.transform(F.split(section, "\n", -1), lambda p: F.trim(F.translate(p, "\r\t", "  "))), lambda p: p != "")


def tree(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Sections, each (node, leaves, long): its hash, 64 bits of its leaves' hashes, and which leaves are of min_chars characters."""
    leaves = lambda s: F.transform(s, lambda p: F.struct(_hash(F.concat(F.lit("p"), p)).alias("h"), (F.length(p) >= min_chars).alias("long")))

    def section(z: Column) -> Column:
        node = _hash(F.concat(F.lit("s"), F.array_join(F.transform(z, lambda x: x["h"]), "")))
        return F.struct(node.alias("node"), F.transform(z, lambda x: F.xxhash64(x["h"])).alias("leaves"), F.transform(z, lambda x: x["long"]).alias("long"))

    sections = F.filter(F.transform(F.split(text, "\n[ \t\r]*\n", -1), _paragraphs), lambda s: F.size(s) > 0)
    return F.transform(F.transform(sections, leaves), section)


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """id, root, r (64 bits of it), sections (node, leaves, long, in 64 bits) of each row; computed once."""
    rows = docs.select(whole_id(id_col).alias("id"), tree(quoted(text_col).cast("string"), min_chars).alias("tree")).where("id is not null")
    root = _hash(F.concat(F.lit("r"), F.array_join(F.transform("tree", lambda s: s["node"]), "")))
    short = F.transform("tree", lambda s: F.struct(F.xxhash64(s["node"]).alias("node"), s["leaves"].alias("leaves"), s["long"].alias("long")))
    return cut(rows.select("id", root.alias("root"), short.alias("sections")).withColumn("r", F.when(F.col("root").isNotNull(), F.xxhash64("root"))))


def differing(mine: Column, other: Column) -> Column:
    """'section.paragraph', both from 1, of mine's paragraphs below differing branches that other hasn't."""
    nodes = F.transform(other, lambda s: s["node"])
    leaves = F.array_distinct(F.flatten(F.transform(other, lambda s: s["leaves"])))

    def branch(s: Column, i: Column) -> Column:
        places = F.transform(s["leaves"], lambda p, j: F.when(~F.array_contains(leaves, p), F.concat_ws(".", (i + 1).cast("string"), (j + 1).cast("string"))))
        return F.when(F.array_contains(nodes, s["node"]), F.array().cast("array<string>")).otherwise(F.array_compact(places))

    return F.flatten(F.transform(mine, branch))


def _told(df: DataFrame, small: DataFrame, on: list[str] | str) -> DataFrame:
    """df joined with a table that is broadcast if it is small; else the many rows of one key are split by adaptive execution."""
    return df.join(F.broadcast(small) if fits(small) else small, on)


def overlaps(items: DataFrame, paired: int = PAIRED, earlier: bool = True) -> DataFrame:
    """key, both, other: for each item the other with the smallest key that shares so many leaves, for each number that is at least need.

    items: key (a struct that begins with an id), need (null: it is only looked for), leaves. earlier: others have smaller
    ids; else any other will do, the item itself, too.
    """
    rows = items.select("key", F.explode("leaves").alias("leaf"))
    shared = cut(rows.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"))
    few, many = shared.where(F.col("n") <= paired), shared.where(F.col("n") > paired)
    counted = rows.join(few, "leaf").union(_told(rows, many, "leaf").select("leaf", "key", "n"))
    # each item's leaves that others have, too, from rare to frequent; a base has one of the first, or not enough of the rest
    sets = counted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "leaf"))).alias("ordered")).join(items.select("key", "need"), "key")
    sets = cut(sets.select("key", "need", "ordered", F.transform(F.filter("ordered", lambda x: x["n"] > paired), lambda x: x["leaf"]).alias("rest")))
    leaves = lambda c: F.transform(F.filter(c, lambda x: x["n"] <= paired), lambda x: x["leaf"])
    first = F.slice("ordered", 1, F.greatest(F.size("ordered") - F.col("need") + 1, F.lit(0)))
    mine = sets.where("need <= size(ordered)").select("key", F.explode(leaves(first)).alias("leaf"))
    theirs = sets.select(F.col("key").alias("other"), F.explode(leaves(F.col("ordered"))).alias("leaf"))
    pairs = mine.join(theirs, "leaf").where(F.col("other.id") < F.col("key.id") if earlier else F.col("other") != F.col("key")).select("key", "other").distinct()
    every = F.transform("ordered", lambda x: x["leaf"])
    found = pairs.join(sets.select("key", "need", every.alias("a")), "key").join(sets.select(F.col("key").alias("other"), every.alias("b")), "other")
    found = found.select("key", F.size(F.array_intersect("a", "b")).alias("both"), "other", "need").where("both >= need").select("key", "both", "other")
    if not earlier:
        found = found.union(items.where("need <= size(leaves)").select("key", F.size("leaves").alias("both"), F.col("key").alias("other")))
    found = found.groupBy("key", "both").agg(F.min("other").alias("other"))
    if many.isEmpty():
        return found
    # pairs that share frequent leaves only: for each set of these, once
    wanted = F.when(F.col("need") <= F.size("rest"), F.col("need"))
    groups = cut(sets.where(F.size("rest") > 0).groupBy("rest").agg(F.min("key").alias("first"), F.min(wanted).alias("need")).select(F.col("first").alias("key"), "need", F.col("rest").alias("leaves")))
    if 2 * groups.count() > sets.count():
        paired *= 4  # few items have the same set: more pairs, so that this ends
    far = overlaps(groups, paired, earlier=False)
    far = cut(groups.join(far, "key").select(F.col("leaves").alias("rest"), "both", "other"))
    lifted = _told(sets.where("need <= size(rest)").select("key", "need", "rest"), far, "rest").where("both >= need")
    lifted = lifted.where(F.col("other.id") < F.col("key.id") if earlier else F.lit(True)).select("key", "both", "other")
    return found.union(lifted).groupBy("key", "both").agg(F.min("other").alias("other"))


def edits(each: DataFrame, min_share: float = MIN_SHARE, paired: int = PAIRED) -> DataFrame:
    """id, r, base_id, base_r: for each root's first document the earlier one that has most of its telling paragraphs."""
    flat = lambda name: F.flatten(F.transform("sections", lambda s: s[name]))
    telling = F.array_distinct(F.transform(F.filter(F.arrays_zip(flat("leaves").alias("leaf"), flat("long").alias("long")), lambda z: z["long"]), lambda z: z["leaf"]))
    firsts = each.where("root is not null").groupBy("r").agg(F.min(F.struct("id", telling.alias("leaves"))).alias("first"))
    need = F.greatest(F.ceil(F.lit(min_share) * F.size("first.leaves") - 1e-9).cast("int"), F.lit(1))
    items = cut(firsts.where(F.size("first.leaves") > 0).select(F.struct("first.id", "r").alias("key"), need.alias("need"), F.col("first.leaves").alias("leaves")))
    best = overlaps(items, paired).groupBy("key").agg(F.min(F.struct((-F.col("both")).alias("less"), "other")).alias("best"))
    return best.select("key.id", "key.r", F.col("best.other.id").alias("base_id"), F.col("best.other.r").alias("base_r"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, min_chars: int = MIN_CHARS, paired: int = PAIRED) -> DataFrame:
    """doc_id, root, n_sections, n_paragraphs, same_as, base_id, changed, removed, for each row.

    same_as: the smallest doc_id with this root. base_id: of a document that is the first with its root, the earlier one
    that it is an edit of, or null; changed: its paragraphs that the base hasn't; removed: those of the base that it hasn't.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    each = trees(docs, id_col, text_col, min_chars)
    size = lambda x: F.when(F.col("root").isNull(), 0).otherwise(F.coalesce(F.size(x), F.lit(0)))
    nodes = each.select("id", "root", "r", size("sections").alias("n_sections"), size(F.flatten(F.transform("sections", lambda s: s["leaves"]))).alias("n_paragraphs"))
    firsts = nodes.where("root is not null").groupBy("root").agg(F.min("id").alias("same_as"))
    pairs = cut(edits(each, min_share, paired))
    # the trees of both sides; only those are shuffled, and a row for each pair
    small = each.select("id", "r", F.transform("sections", lambda s: F.struct(s["node"].alias("node"), s["leaves"].alias("leaves"))).alias("sections"))
    asked = pairs.select("r").union(pairs.select("base_r")).distinct()
    wanted = cut(semi(small, asked, "r").dropDuplicates(["id", "r"]))
    bases = wanted.select(F.col("id").alias("base_id"), F.col("r").alias("base_r"), F.col("sections").alias("base"))
    changes = pairs.join(wanted, ["id", "r"]).join(bases, ["base_id", "base_r"])
    changes = changes.select("id", "r", "base_id", differing(F.col("sections"), F.col("base")).alias("changed"), differing(F.col("base"), F.col("sections")).alias("removed"))
    out = nodes.join(firsts, "root", "left").join(changes, ["id", "r"], "left")
    return out.select(F.col("id").alias("doc_id"), "root", "n_sections", "n_paragraphs", "same_as", "base_id", "changed", "removed")
