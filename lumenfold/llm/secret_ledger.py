"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by its content (SHA-256 of its UTF-8 bytes). The ledger is a Parquet folder
that holds, for each blob, the rule versions that have scanned it and what they found. A scan

1. addresses all versions and takes each blob once, however many paths and versions hold it;
2. joins the blobs with the ledger and scans those, by those rule versions, that it lacks;
3. appends the scans in one write, so a run that fails leaves no mark and its blobs are scanned again;
4. joins the findings back to all paths and versions by content.

A rule's version follows from its definition: a changed rule scans everything again, beside the findings of the old one.

Defined results: a null text is the empty text; spans count code points, the end is exclusive; each rule's matches are
leftmost and do not overlap one another, those of different rules may; a match that is shorter than its rule asks is
dropped but still takes its characters. Letters outside ASCII are never letters of a keyword. Spans are ordered by
start, then by the order of the rules. Rows that repeat are all returned; other columns are kept, but those named spans
and blob are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import folder, release, table


@dataclass(frozen=True)
class Rule:
    """pattern finds matches; those whose group has fewer than least characters are dropped. hints: text, in lower case, of which each match holds some (none: no hint)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        """The kind and a hash of what decides its matches."""
        decides = repr((self.pattern, self.least, self.group, self.any_case))
        return f"{self.kind}@{hashlib.sha256(decides.encode()).hexdigest()[:16]}"


# The three kinds that a scan must report, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Beside them: key blocks and tokens of forms that prose does not take.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----", hints=("private key-----",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", hints=("eyj",)),
    Rule("prefixed", r"(?:gh[opsu]|glpat|xox[abp]|sk_live)[_-][A-Za-z0-9_-]{20,}", hints=("gho_", "ghp_", "ghs_", "ghu_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "sk_live_")),
)
RULES = BASE + MORE

LEDGER = "blob binary, versions array<string>, found array<struct<version:string,start:int,end:int>>"
_LEDGER = pa.schema([("blob", pa.binary()), ("versions", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _compiled(rule: Rule) -> re.Pattern:
    pattern = rule.pattern
    if rule.pattern.endswith("]+") and rule.least and not rule.group:
        # a run of one class: where the longest match from a place is too short, so are all within it
        fixed = len(re.match(r"[A-Z]*", rule.pattern)[0])
        pattern = f"{rule.pattern[:-1]}{{{rule.least - fixed},}}"
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


class Scanner:
    """Matches of rules in texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self._rules = {r.version: (r, _compiled(r)) for r in rules}

    def scan(self, text: str, versions: list[str]) -> Iterator[tuple[str, int, int]]:
        """(version, start, end) of the matches of the rules of these versions."""
        lowered = text.encode("utf-8", "surrogatepass").translate(_LOWERED)
        for version in versions:
            rule, pattern = self._rules[version]
            if rule.hints and not any(h.encode() in lowered for h in rule.hints):
                continue
            for m in pattern.finditer(text):
                if len(m[rule.group]) >= rule.least:
                    yield version, m.start(), m.end()


def blob(text: Column) -> Column:
    """The address of a text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger's rows at path; none where nothing has been scanned."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what versions (text) hold of blobs and rule versions that the ledger at path lacks, and append it there."""
    spark = versions.sparkSession
    asked = F.array(*[F.lit(r.version) for r in rules])
    blobs = versions.select(blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = read_ledger(spark, path).groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))  # as many as rule versions there have been
    missing = F.array_except(asked, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = blobs.join(seen, "blob", "left").withColumn("missing", missing).where(F.size("missing") > 0)

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "missing")), strict=True)
            out = [{"blob": b, "versions": v, "found": [dict(zip(("version", "start", "end"), x, strict=True)) for x in scanner.scan(t, v)]} for b, t, v in rows]
            yield pa.RecordBatch.from_pylist(out, schema=_LEDGER)

    unseen.select("blob", "text", "missing").mapInArrow(run, LEDGER).write.mode("append").option("compression", "zstd").parquet(path)


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions (text and any other columns) with blob and spans: array of (kind, start, end) that the ledger at path holds for these rules."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    known = read_ledger(versions.sparkSession, path).where(F.size("found") > 0).select("blob", F.inline("found"))
    # a pair that two runs scanned at once is listed twice
    known = known.withColumn("rule", order[F.col("version")]).where("rule is not null").groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rule", "end"))).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(F.get(kinds, s["rule"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    own = versions.drop("spans", "blob").withColumn("blob", blob(F.col("text")))
    found = own.join(known, "blob", "left")
    return found.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int>>"))).select(*own.columns, "spans")


def _of(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A scan of docs (doc_id, text) with a ledger of its own: doc_id, n_assign, n_access, n_hex, base_sha256 and spans, listed as kind:start:end."""
    path = folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    update_ledger(docs, path, rules)
    found = findings(docs, path, rules)
    counts = [F.size(_of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    result = table(found.select("doc_id", *counts, F.sha2(_listed(_of(*[r.kind for r in BASE])), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")))
    release(read_ledger(docs.sparkSession, path))
    return result
