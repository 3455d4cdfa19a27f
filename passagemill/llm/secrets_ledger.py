"""Operator 1, secret scans: an incremental blob ledger.

Every version of every document is a blob, named by the SHA-256 of its bytes. The ledger has two
tables: paths, where each batch appends which document had which blob, so the history of a document
is kept; and findings, a row for each scanned pair of blob and rule version, also where nothing was
found. A scan takes only blobs that findings lacks under the current rules, each distinct text once
however many paths hold it, and findings are joined back to all paths, those of earlier batches
included. The rule version is a digest of the rules. A batch under changed rules scans its own blobs
again; rescan does so for the whole history: it is given texts (the ledger keeps none), takes those
whose blob any batch recorded and the rules haven't seen, and its findings join to all of their paths.
lacking says what is left. Batches that run at one time may scan a blob twice; reading takes each pair
once. A blob of very many paths is joined where they are.

Defined cases: a null text is the empty blob. Repeated rows give repeated results. Spans are in code
points, end exclusive. A path whose blob wasn't scanned under the rules keeps its row, with null spans.
Very long texts are scanned whole. Extra columns, whatever their names, are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, FEW, HOT_KEYS, map_texts, materialize, read_documents, shared_dir, text_of

#: The rules, in the order in which equal starts are listed: pattern, group whose length counts, least length, a string or strings (lower case) without which nothing matches.
RULES: tuple[tuple[str, str, int, int, tuple[str, ...]], ...] = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    ("hex", r"[0-9a-f]{16,}", 0, 16, ()),
)

Rules = tuple[tuple[str, str, int, int, tuple[str, ...]], ...]
PATHS = "doc_id long, blob string, batch string"
FINDINGS = "blob string, rules string, spans array<struct<kind:string,start:int,end:int>>"


def rule_version(rules: Rules) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules: list[tuple]) -> list[tuple[str, int, int]]:
    """Spans by start, then by the rules' order."""
    lower, spans = text.lower(), []
    for order, (kind, pattern, group, least, needed) in enumerate(rules):
        if not needed or any(x in lower for x in needed):
            spans += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(spans)]


def scan(blobs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text)."""
    compiled = [(kind, re.compile(pattern, re.ASCII), group, least, needed) for kind, pattern, group, least, needed in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def spans(texts: list[str]) -> list:
        return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t, compiled)] for t in texts], kind)]

    return map_texts(blobs, spans, "spans array<struct<kind:string,start:int,end:int>>", ["blob"]).select("blob", F.lit(rule_version(rules)).alias("rules"), "spans")


class Ledger:
    """The tables of a ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def paths(self) -> DataFrame:
        return self._read("paths", PATHS)

    def scanned(self, rules: Rules = RULES) -> DataFrame:
        """blob and spans of what was scanned under the rules, each blob once."""
        return self._read("findings", FINDINGS).where(F.col("rules") == rule_version(rules)).dropDuplicates(["blob"]).select("blob", "spans")

    def update(self, docs: DataFrame, rules: Rules = RULES) -> tuple[str, int]:
        """Record docs (doc_id, text) as a batch and scan what the ledger lacks. Returns the batch's name and how many blobs were scanned."""
        batch = uuid.uuid4().hex
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_of(), 256).alias("blob"), text_of().alias("text"))
        named.select("doc_id", "blob", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/paths")
        known = self.scanned(rules).select("blob")
        blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
        return batch, self._scan(blobs if known.isEmpty() else blobs.join(known, "blob", "left_anti"), rules)

    def lacking(self, rules: Rules = RULES) -> DataFrame:
        """blob of every recorded version that wasn't scanned under the rules."""
        return self.paths().select("blob").distinct().join(self.scanned(rules).select("blob"), "blob", "left_anti")

    def rescan(self, versions: DataFrame, rules: Rules = RULES) -> int:
        """Scan recorded blobs of all batches that lack these rules, as far as versions (text, one or many for a blob) holds their texts. Returns how many were scanned."""
        named = versions.select(F.sha2(text_of(), 256).alias("blob"), text_of().alias("text"))
        wanted = materialize(self.lacking(rules), "lacking")
        return self._scan(named.join(wanted, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")), rules)

    def _scan(self, blobs: DataFrame, rules: Rules) -> int:
        watch = Observation()
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # the texts that were shuffled are not needed after the scan
        try:
            scan(blobs, rules).observe(watch, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.path}/findings")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return watch.get["n"]

    def findings(self, batch: str | None = None, rules: Rules = RULES) -> DataFrame:
        """doc_id, blob, batch, spans of every recorded row, or of one batch's; spans are null where a blob wasn't scanned under the rules."""
        paths = self.paths() if batch is None else self.paths().where(F.col("batch") == batch)
        most = max(FEW, paths.count() // HOT_KEYS)
        often = materialize(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("blob"), "frequent-blobs")
        scanned, columns = self.scanned(rules), ["doc_id", "blob", "batch", "spans"]
        if often.isEmpty():
            return paths.join(scanned, "blob", "left").select(*columns)
        keys = F.broadcast(often)  # HOT_KEYS at most
        hot = paths.join(keys, "blob", "left_semi").join(F.broadcast(scanned.join(keys, "blob", "left_semi")), "blob", "left")
        return hot.select(*columns).unionByName(paths.join(keys, "blob", "left_anti").join(scanned, "blob", "left").select(*columns))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of findings."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, f"{shared_dir(spark)}/passagemill/{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}")
    batch, _ = ledger.update(read_documents(spark, sf_dir))
    return digests(ledger.findings(batch))
