"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content, its blob. A ledger keeps which rules, in which
version, have scanned which blob, and what they found. A scan works out which pairs of blob and rule version are new,
reads one copy of each such blob, applies its new rules only, adds to the ledger, and joins all findings back to every
path and version that has the blob. A new path of a known blob, or a known history, costs no scan; a rule whose version
changes is applied again, the others aren't.

The ledger is a folder of Parquet tables, only ever added to: findings are written before the blobs count as scanned, so
that a scan that is broken off is done again by the next one; findings are then the same rows and count once. All that is
done by built-in expressions.

Which copies to read is told to the tasks in the cheapest way there is: a list of the rows to leave out or of those to
read, broadcast if it is short, else a shuffled join.

Defined cases: null text: no blob, no findings. Empty text: a blob like others. Null path or version: kept as null.
Repeated rows, or equal texts under many paths: one blob, findings for each distinct path and version. Very long texts:
whole. Ties: whichever copy of a blob is read, it is the same. No rows: no findings; an empty ledger is made. Ids play no
part but as paths. Other columns are ignored. The findings hold a hash of a secret, never the secret.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import cut, fits, new_path, quoted


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str  # in the part that Java's and RE2's expressions share

    @property
    def key(self) -> str:
        return f"{self.name}:{self.version}"


RULES = (
    Rule("assigned_secret", 1, r"""(?i:api[_-]?key|secret|token|password|passwd|pwd)["']?[ \t]{0,4}[=:][ \t]{0,4}["'][A-Za-z0-9+/_=.-]{16,}["']"""),
    Rule("cloud_access_key", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    Rule("code_host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
_SCANNED = "blob string, rules array<string>"
_FINDINGS = "blob string, rule string, rule_version int, secret string, n long"


class Ledger:
    """What has been scanned and found, in two folders of Parquet files under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", _FINDINGS).distinct()

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.path}/findings")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")


def _found(rules: list[Rule], todo: Column, text: Column) -> Column:
    """An array of (rule, rule_version, secret's hash) of the rules in todo."""
    none = F.array().cast("array<struct<rule:string,rule_version:int,secret:string>>")

    def hits(r: Rule) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)), lambda s: F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.sha2(s.cast("binary"), 256).alias("secret")))

    return F.concat(none, *[F.when(F.array_contains(todo, r.key), hits(r)).otherwise(none) for r in rules])


def _copies(rows: DataFrame, first: DataFrame, skipped: DataFrame) -> DataFrame:
    """Of rows (row, text) those that first (row, todo) names, with todo."""
    todos = first.select("todo").distinct().limit(2).collect()
    if len(todos) != 1:
        return rows.join(F.broadcast(first) if fits(first) else first, "row")
    # the rules are the same for all, so only row numbers need to be told
    if fits(skipped):
        chosen = rows.join(F.broadcast(skipped), "row", "left_anti")
    else:
        chosen = rows.join(F.broadcast(first.select("row")) if fits(first) else first.select("row"), "row", "left_semi")
    return chosen.withColumn("todo", F.array(*[F.lit(x) for x in todos[0].todo]))


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, path_col: str = "path", version_col: str = "version", text_col: str = "text") -> DataFrame:
    """path, version, blob, rule, rule_version, secret (its SHA-256), n (how often it is in the blob), of all versions given.

    The ledger has what it had and what this scan added.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("one version of each rule at a time")
    text = quoted(text_col).cast("string")
    base = versions.select(quoted(path_col).cast("string").alias("path"), quoted(version_col).cast("string").alias("version"), text.alias("text")).where("text is not null")
    blob = F.sha2(F.col("text").cast("binary"), 256)
    parts = (F.coalesce("path", F.lit("\0")), F.coalesce("version", F.lit("\0")), "text")
    row = F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))  # 128 bits
    every = cut(base.select("path", "version", blob.alias("blob"), row.alias("row")).groupBy("path", "version", "blob", "row").agg(F.count("*").alias("times")))
    known = ledger.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    keys = F.array(*[F.lit(r.key) for r in rules]) if rules else F.array().cast("array<string>")
    blobs = every.groupBy("blob").agg(F.min_by(F.struct("row", "times"), "row").alias("x")).select("blob", "x.*")
    first = cut(blobs.join(known, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("known"))
    skipped = every.join(first, "row", "left_anti").select("row")
    rows = base.select(row.alias("row"), "text")
    hits = _copies(rows, first.select("row", "todo"), skipped).select("row", F.explode(_found(list(rules), F.col("todo"), F.col("text"))).alias("f"))
    found = hits.groupBy("row", "f.rule", "f.rule_version", "f.secret").agg(F.count("*").alias("n"))
    # repeated rows of one path, version and blob are all scanned; the count is that of one of them
    found = found.join(first, "row").select("blob", "rule", "rule_version", "secret", (F.col("n") / F.col("times")).cast("long").alias("n"))
    ledger.add(found, first.select("blob", F.col("todo").alias("rules")))
    wanted = ledger.spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
    all_found = ledger.findings().join(F.broadcast(wanted), ["rule", "rule_version"])
    return every.join(all_found, "blob").select("path", "version", "blob", "rule", "rule_version", "secret", "n")


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """scan() of documents, each a path source/doc_id of one version; a ledger of its own unless one is given."""
    spark = docs.sparkSession
    history = docs.select(F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("path"), F.lit("1").alias("version"), "text")
    return scan(history, ledger or Ledger(spark, new_path(spark, "blob-ledger")), rules)


