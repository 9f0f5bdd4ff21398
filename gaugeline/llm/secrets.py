"""Secret scans over an incremental ledger of blobs. DataFrame operations only.

Every version of every path is content-addressed: its blob is the SHA-256 of the text. The ledger holds one row for
each blob and rule version that was scanned, with the findings. A scan takes the versions' distinct blobs, drops the
blob and rule pairs that the ledger has, scans the rest once each, adds them to the ledger, and joins the findings
back to all paths. The hot blob of a third of all paths is one row after the partial aggregate, and only ids meet the
findings in the join, which adaptive execution splits.

Rules are patterns scanned from left to right without overlap; a match too short is dropped and not retried. Where a
pattern matches, the text's pieces between the matches and the matches themselves give each match's start in code
points. Base rules: assign, access, hex. Further ones: pem (private key headers) and jwt (signed web tokens). op4_secrets
scans the documents into a new ledger and joins its findings back.

A null text is an empty one; it has no findings. Repeated rows are repeated. Null ids are kept. Other columns are not read.
Whole texts are scanned, in time linear in their length, but for the square of the number of matches in one text, of which
each step is the copy of a reference (a text of ten thousand secrets takes about a tenth of a second for it).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, table

VERSION = 1


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # whose length counts
    least: int
    version: int = VERSION


# The patterns of the base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULES = BASE + MORE
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Start, rank of the kind, end and kind of each match of a rule that is long enough."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.char_length)
    sized = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length) if rule.group else whole
    none = F.array().cast(_SPANS)
    walk = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), sized.alias("sized")),
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["whole"]).alias("at"),
            F.when(m["sized"] >= rule.least, F.concat(acc["found"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + m["gap"] + m["whole"]).alias("end"), F.lit(rule.kind).alias("kind")))).cast(_SPANS)).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(text.rlike(rule.pattern), walk).otherwise(none)


def blobs(versions: DataFrame, text_col: str) -> DataFrame:
    """The distinct blobs: address and text."""
    own = versions.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    return own.select(F.sha2("content", 256).alias("blob"), "content").groupBy("blob").agg(F.first("content").alias("content"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows: blob, kind, version, found (start, rank, end, kind). Only unseen pairs are scanned."""
    todo = blobs(versions, text_col)
    if ledger is None:
        parts = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), matches(F.col("content"), r, k).alias("found")) for k, r in enumerate(rules)]
        return todo.select("blob", F.explode(F.array(*parts)).alias("s")).select("blob", "s.*")
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    todo = todo.join(seen, "blob", "left")
    unseen = lambda r: F.coalesce(~F.array_contains("seen", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.lit(True))
    parts = [F.when(unseen(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), matches(F.col("content"), r, k).alias("found"))) for k, r in enumerate(rules)]
    return todo.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("s")).select("blob", "s.*")


def update(versions: DataFrame, ledger_path: str, **options) -> DataFrame:
    """Scan what the ledger at a path lacks, append it there, and return the ledger. The folder may not exist yet."""
    spark = versions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    scan(versions, spark.read.parquet(ledger_path) if there else None, **options).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def findings(versions: DataFrame, ledger: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with the spans found in its blob under the rules' versions, by start and then kind."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    hits = ledger.filter(F.size("found") > 0).filter(F.array_contains(current, F.struct("kind", "version")))
    hits = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("spans"))
    paths = versions.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob"))
    return paths.join(hits, "blob", "left").select(id_col, "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, update(docs, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, s AS start, s + length(m) AS stop FROM (
  SELECT doc_id, ms[i] AS m, gs[i] AS sized, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i-1]]), 0) AS s FROM (
    SELECT doc_id, ms, gs, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS gs, string_split_regex(text, '{pattern}') AS gaps
      FROM documents WHERE regexp_matches(text, '{pattern}'))))
WHERE length(sized) >= {rule.least}"""


ORACLE = f"""
WITH f AS ({" UNION ALL ".join(_sql(r, k) for k, r in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256,
  string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""
