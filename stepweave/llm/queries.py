"""The operators' queries over the whole tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import bpe, decontaminate, fingerprints, jaccard_join, language_id, license_scan, line_dedup, pii, secret_scan, toxicity
from stepweave.llm.common import table
from stepweave.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents similar to another by word pairs (a Jaccard similarity of 0.6 and more): their group, class and number of links."""
    return jaccard_join.near_duplicate_groups(table(ship(spark), sf_dir, "documents"), n=2, threshold=0.6)


#: A word of its own: kana and ideographs.
_ALONE = "([\\x{3041}-\\x{3096}\\x{309F}\\x{30A1}-\\x{30FA}\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}])"


def _words(text: str) -> str:
    """SQL for the list of a text's words."""
    return f"regexp_extract_all(lower(regexp_replace({text}, '{_ALONE}', ' \\1 ', 'g')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"


#: Word pairs of each document; a document of one word has that, one of none has ''.
OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words("text")} AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gs FROM w
), t AS (
  SELECT doc_id, len(gs) AS n, unnest(gs) AS gram FROM g
), few AS (
  SELECT doc_id, n, gram, count(*) OVER (PARTITION BY gram) AS df FROM t
), p AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, gram) AS k FROM few
), pre AS (
  SELECT * FROM p WHERE k <= n - ceil(0.6 * n - 1e-9) + 1
), c AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM pre x JOIN pre y ON x.gram = y.gram AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.6 * greatest(x.n, y.n) - 1e-9
), k AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(gs)) AS class_id FROM g
), e AS (
  SELECT a, b FROM c JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b
  WHERE len(list_intersect(ga.gs, gb.gs)) >= 0.6 * (len(ga.gs) + len(gb.gs) - len(list_intersect(ga.gs, gb.gs))) - 1e-9
), links AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT a AS doc_id, a AS root FROM links UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.doc_id
), m AS (
  SELECT doc_id, min(root) AS group_id FROM r GROUP BY doc_id
), n AS (
  SELECT a AS doc_id, count(DISTINCT y.class_id) AS n_links FROM links JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE x.class_id <> y.class_id GROUP BY a
)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, class_id, coalesce(n_links, 0) AS n_links FROM m JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents' blobs, joined back to every path that has the blob."""
    return secret_scan.scan_documents(table(ship(spark), sf_dir, "documents"))


OP2_SQL = (
    "WITH b AS (SELECT DISTINCT concat(coalesce(source, ''), '/', CAST(doc_id AS VARCHAR)) AS path, '1' AS version, text, sha256(text) AS blob FROM documents WHERE text IS NOT NULL), f AS ("
    + " UNION ALL ".join(f"SELECT path, version, blob, '{r.name}' AS rule, CAST({r.version} AS INTEGER) AS rule_version, unnest(regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}')) AS found FROM b" for r in secret_scan.RULES)
    + ") SELECT path, version, blob, rule, rule_version, sha256(found) AS secret, count(*) AS n FROM f GROUP BY ALL"
)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that three and more sources have, but where such a line comes first."""
    cleaned = line_dedup.remove_spread_lines(table(ship(spark), sf_dir, "documents"), min_sites=3, min_chars=10, removed_col="n_removed")
    return cleaned.select("doc_id", "text", "n_removed")


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), s AS (
  SELECT trim(line, ' ') AS bare, min((doc_id, place)) AS first FROM l WHERE length(trim(line, ' ')) >= 10
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(0))) >= 3
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (first IS NULL OR first = (doc_id, place)), '') AS text,
       CAST(count(*) FILTER (first IS NOT NULL AND first <> (doc_id, place)) AS INTEGER) AS n_removed
FROM l LEFT JOIN s ON trim(line, ' ') = bare GROUP BY doc_id
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, and whether decoding them gives the text again."""
    return bpe.encode_documents(table(ship(spark), sf_dir, "documents"), keep=["doc_id"], check=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score and verdict, by a lexicon that the labelled documents extend."""
    docs = table(ship(spark), sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs.select("doc_id", "text"), lexicon).drop("text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's root, the first document with the same, and what it changes of an earlier one that it is an edit of."""
    return fingerprints.fingerprints(table(ship(spark), sf_dir, "documents"))


OP6_SQL = r"""
WITH p AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda s: list_filter(list_transform(string_split(s, chr(10)), lambda p: trim(replace(replace(p, chr(13), ' '), chr(9), ' '), ' ')), lambda p: p <> '')), lambda s: len(s) > 0) AS sections
  FROM documents WHERE doc_id IS NOT NULL
), h AS (
  SELECT doc_id, sections, list_transform(sections, lambda s: list_transform(s, lambda p: sha256('p' || p))) AS leaves FROM p
), n AS (
  SELECT *, list_transform(leaves, lambda s: sha256('s' || array_to_string(s, ''))) AS nodes FROM h
), t AS (
  SELECT *, sha256('r' || array_to_string(nodes, '')) AS root FROM n
), f AS (
  SELECT root, min(doc_id) AS same_as FROM t WHERE root IS NOT NULL GROUP BY root
), l AS (
  SELECT doc_id, leaf, count(*) OVER (PARTITION BY doc_id) AS n FROM (
    SELECT DISTINCT doc_id, sha256('p' || par) AS leaf FROM (SELECT doc_id, unnest(flatten(sections)) AS par FROM p) WHERE length(par) >= 20)
), c AS (
  SELECT l.doc_id, l.n, y.doc_id AS first, count(*) AS shared FROM l JOIN l y USING (leaf) WHERE y.doc_id < l.doc_id GROUP BY ALL
), b AS (
  SELECT doc_id, first AS base_id FROM c WHERE shared >= 0.5 * n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, first) = 1
), e AS (
  SELECT x.doc_id, b.base_id, x.leaves AS mine, y.leaves AS other, x.nodes AS mine_nodes, y.nodes AS other_nodes
  FROM t x JOIN f ON x.root = f.root AND x.doc_id = f.same_as JOIN b ON b.doc_id = x.doc_id JOIN t y ON y.doc_id = b.base_id
), d AS (
  SELECT doc_id, base_id,
    flatten(list_transform(range(1, len(mine) + 1), lambda i: CASE WHEN list_contains(other_nodes, mine_nodes[i]) THEN [] ELSE list_transform(list_filter(range(1, len(mine[i]) + 1), lambda j: NOT list_contains(flatten(other), mine[i][j])), lambda j: i || '.' || j) END)) AS changed,
    flatten(list_transform(range(1, len(other) + 1), lambda i: CASE WHEN list_contains(mine_nodes, other_nodes[i]) THEN [] ELSE list_transform(list_filter(range(1, len(other[i]) + 1), lambda j: NOT list_contains(flatten(mine), other[i][j])), lambda j: i || '.' || j) END)) AS removed
  FROM e
)
SELECT t.doc_id, t.root, CAST(coalesce(len(sections), 0) AS INTEGER) AS n_sections, CAST(coalesce(len(flatten(sections)), 0) AS INTEGER) AS n_paragraphs, f.same_as, d.base_id, d.changed, d.removed
FROM t LEFT JOIN f USING (root) LEFT JOIN d ON d.doc_id = t.doc_id
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language and the confidence, by a model of a sample of the labelled ones."""
    docs = table(ship(spark), sf_dir, "documents")
    return language_id.identify(docs.select("doc_id", "lang", "text"), language_id.fit(docs)).drop("text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, blocks and windows of paragraphs of all documents that hold a license template."""
    return license_scan.license_matches(table(ship(spark), sf_dir, "documents"), windows=True)


_TEMPLATE_ROWS = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in license_scan.TEMPLATES.items())
OP8_SQL = rf"""
WITH v(template, words) AS (VALUES {_TEMPLATE_ROWS}), t AS (
  SELECT template, list_distinct({_words("words")}) AS ws, len({_words("words")}) AS n_all FROM v
), d AS (
  SELECT DISTINCT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM d
), r AS (
  SELECT *, count(*) FILTER (regexp_full_match(line, '\s*')) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM l
), k AS (
  SELECT doc_id, run, place, 1 AS n_lines, line AS block FROM r
  UNION ALL
  SELECT doc_id, run, min(place), count(*), string_agg(line, chr(10) ORDER BY place) FROM r WHERE NOT regexp_full_match(line, '\s*') GROUP BY ALL HAVING count(*) > 1
), m AS (
  SELECT doc_id, run, place, n_lines, template, len(list_intersect(ws, list_distinct({_words("block")}))) AS shared, len(ws) AS n FROM k, t
), f AS (
  SELECT * FROM m WHERE shared >= ceil({license_scan.THRESHOLD} * n - 1e-9)
), p AS (
  SELECT doc_id, run, min(place) AS first, max(place) AS last, sum(len({_words("line")})) AS n_words, list_distinct(flatten(list({_words("line")}))) AS ws FROM r WHERE NOT regexp_full_match(line, '\s*') GROUP BY doc_id, run
), q AS (
  SELECT *, sum(n_words) OVER (PARTITION BY doc_id ORDER BY run) AS upto FROM p
), whole AS (
  SELECT doc_id, template, t.ws AS own, n_all, ceil({license_scan.THRESHOLD} * len(t.ws) - 1e-9) AS need FROM (SELECT doc_id, list_distinct(flatten(list(ws))) AS every FROM p GROUP BY doc_id HAVING count(*) > 1), t WHERE len(list_intersect(t.ws, every)) >= ceil({license_scan.THRESHOLD} * len(t.ws) - 1e-9)
), o AS (
  SELECT q.*, template, n_all, need, len(own) AS n, list_intersect(ws, own) AS mine FROM q JOIN whole USING (doc_id) WHERE len(list_intersect(ws, own)) > 0
), w AS (
  SELECT a.doc_id, a.template, a.run AS begins, b.run AS ends, a.first, b.last, a.n, len(list_distinct(flatten(list(c.mine)))) AS shared
  FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.template = b.template AND b.run >= a.run AND (b.run = a.run OR b.upto - a.upto + a.n_words <= {license_scan.WINDOW_LENGTH} * a.n_all)
  JOIN o c ON c.doc_id = a.doc_id AND c.template = a.template AND c.run BETWEEN a.run AND b.run
  GROUP BY ALL HAVING len(list_distinct(flatten(list(c.mine)))) >= any_value(a.need)
), s AS (
  SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, template, begins ORDER BY ends) = 1
), z AS (
  SELECT * FROM s x WHERE begins < ends AND NOT EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.template = x.template AND y.begins > x.begins AND y.ends <= x.ends)
)
SELECT doc_id, CAST(place AS INTEGER) AS line, CAST(n_lines AS INTEGER) AS n_lines, template, CAST(shared AS INTEGER) AS shared, CAST(n AS INTEGER) AS template_words FROM f
WHERE n_lines = 1 OR NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.run = f.run AND g.template = f.template AND g.n_lines = 1)
UNION ALL SELECT doc_id, CAST(first AS INTEGER), CAST(last - first + 1 AS INTEGER), template, CAST(shared AS INTEGER), CAST(n AS INTEGER) FROM z
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a benchmark item and a document that holds a phrase of it or most of its rarest words close together."""
    return decontaminate.benchmark_matches(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Phrases of 13 words (or an item's all); else the most of an item's eight rarest words within one and a half times its length.
OP9_SQL = rf"""
WITH i AS (
  SELECT DISTINCT item_id, text, {_words("text")} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), d AS (
  SELECT doc_id, {_words("text")} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), sizes AS (
  SELECT DISTINCT least(len(ws), {decontaminate.PHRASE_WORDS}) AS k FROM i WHERE len(ws) > 0
), ig AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS gram FROM (SELECT *, least(len(ws), {decontaminate.PHRASE_WORDS}) AS k FROM i WHERE len(ws) > 0)
), dg AS (
  SELECT doc_id, k, unnest(range(0, len(ws) - k + 1)) AS place, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS gram FROM d, sizes WHERE len(ws) >= k
), phrases AS (
  SELECT item_id, doc_id, 'phrase' AS kind, min(place) AS place, max(k) AS n FROM ig JOIN dg USING (k, gram) GROUP BY item_id, doc_id
), dw AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM d
), totals AS (
  SELECT word, count(*) AS total FROM dw GROUP BY word
), iw AS (
  SELECT item_id, text, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM i WHERE len(ws) >= {decontaminate.MIN_WORDS}
), firsts AS (
  SELECT item_id, text, n, word, min(pos) AS pos, coalesce(any_value(total), 0) AS total FROM iw LEFT JOIN totals USING (word) GROUP BY ALL
), rare AS (
  SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY total, pos) <= {decontaminate.RAREST}
), asked AS (
  SELECT item_id, text, ceil({decontaminate.SPREAD} * n) AS span, greatest(3, ceil({decontaminate.SHARE} * count(*))) AS need FROM rare GROUP BY item_id, text, n
), places AS (
  SELECT DISTINCT r.item_id, r.text, doc_id, place, word FROM rare r JOIN dw USING (word)
), enough AS (
  SELECT item_id, text, doc_id, any_value(need) AS need, any_value(span) AS span FROM places JOIN asked USING (item_id, text) GROUP BY item_id, text, doc_id HAVING count(DISTINCT word) >= any_value(need)
), near AS (
  SELECT a.item_id, a.text, a.doc_id, a.place, count(DISTINCT b.word) AS n
  FROM places a JOIN enough e USING (item_id, text, doc_id) JOIN places b ON b.item_id = a.item_id AND b.text = a.text AND b.doc_id = a.doc_id AND b.place >= a.place AND b.place < a.place + e.span
  GROUP BY ALL HAVING count(DISTINCT b.word) >= any_value(e.need)
), every AS (
  SELECT item_id, doc_id, kind, place, n FROM phrases UNION ALL SELECT item_id, doc_id, 'proximity', place, n FROM near
)
SELECT item_id, doc_id, kind, CAST(place AS INTEGER) AS place, CAST(n AS INTEGER) AS n_words FROM every
QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY kind, n DESC, place) = 1
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without personal values and without the terms that disclose them."""
    return pii.sanitise(table(ship(spark), sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    every = (op1_ngram_jaccard_join, op2_secret_scan, op3_line_dedup, op4_byte_bpe, op5_toxicity, op6_fingerprints, op7_language_id, op8_license_scan, op9_decontamination, op10_pii)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op2_secret_scan": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_fingerprints": OP6_SQL, "op8_license_scan": OP8_SQL, "op9_decontamination": OP9_SQL}
