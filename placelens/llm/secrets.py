"""Secret scans through an incremental ledger of content-addressed blobs.

Every historical version of a file is one row (path key, content). Equal contents share one blob id (SHA-256 of
the UTF-8 bytes). The ledger holds which (blob, rule, rule version) pairs were scanned and what they gave; a run
scans only the pairs that are not in it, appends them, and joins the findings back to every path.

Null content counts as empty, repeated rows each get the findings of their blob, extra columns are not read, and
an empty table gives an empty result. Rules are named; a new version of a rule is scanned again everywhere and
replaces the older findings in results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm.registry import fresh, query, table
from placelens.session import shared_folder


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is matched leftmost without overlap; a match counts if ``group`` has at least ``least`` characters.

    ``needs`` are lower-case strings of which a text must have one to be worth a look; ``run`` is a set of
    characters of which it must have ``least`` in a row. Both only save time.
    """

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1
    flags: int = re.ASCII
    needs: tuple[str, ...] = ()
    run: str = ""


# The patterns of the three kinds, in the order of the result.
RULES = (
    SecretRule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        flags=re.ASCII | re.IGNORECASE,
        needs=("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, needs=("akia",)),
    SecretRule("hex", r"[0-9a-f]+", 0, 24, run="0123456789abcdef"),
)

_SCANNED = "blob string, rule string, version int, spans array<struct<start: bigint, end: bigint>>"


def scanner(rules: Sequence[SecretRule]):
    """Function from one text to the spans of each rule, in code points."""
    tools = []
    for r in rules:
        classes = bytes(1 if chr(i) in r.run else 0 for i in range(256)) if r.run else None
        tools.append((r, re.compile(r.pattern, r.flags), classes, b"\x01" * r.least))

    def scan(text: str) -> list[list[dict]]:
        lower = text.lower()
        raw = None
        found = []
        for rule, pattern, classes, streak in tools:
            if rule.needs and not any(x in lower for x in rule.needs):
                found.append([])
                continue
            if classes is not None:
                raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
                if streak not in raw.translate(classes):
                    found.append([])
                    continue
            hits = [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            found.append([{"start": a, "end": b} for a, b in hits])
        return found

    return scan


def scan_blobs(blobs: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """(blob, rule, version, spans) of every (blob, content, todo) row; ``todo`` names the rules to run."""

    def run(batches):
        scan_of = {}
        for batch in batches:
            out = {"blob": [], "rule": [], "version": [], "spans": []}
            for blob, content, todo in zip(*(batch.column(c).to_pylist() for c in ("blob", "content", "todo"))):
                key = tuple(sorted(todo))
                if key not in scan_of:
                    picked = [r for r in rules if r.name in key]
                    scan_of[key] = picked, scanner(picked)
                picked, scan = scan_of[key]
                for rule, spans in zip(picked, scan(content)):
                    out["blob"].append(blob)
                    out["rule"].append(rule.name)
                    out["version"].append(rule.version)
                    out["spans"].append(spans)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrow = pa.schema([("blob", pa.string()), ("rule", pa.string()), ("version", pa.int32()), ("spans", span)])
    return blobs.mapInArrow(run, _SCANNED)


class BlobLedger:
    """A folder of Parquet parts (blob, rule, version, spans), one part per run, for any number of runs.

    A part is published by one row in ``published``, written when the part is complete. A ledger that is opened again
    reads the published parts; what a run that died has left is not published, never read and never overwritten.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        try:
            rows = spark.read.schema("part string").parquet(f"{folder}/published/*").select("part").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        self.parts = sorted(r["part"] for r in rows)

    def read(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], _SCANNED)
        return self.spark.read.schema(_SCANNED).parquet(*[f"{self.folder}/{p}" for p in self.parts])

    def append(self, rows: DataFrame) -> None:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        self.spark.range(1).select(F.lit(part).alias("part")).coalesce(1).write.parquet(f"{self.folder}/published/{part}")
        self.parts.append(part)

    def findings(self, rules: Sequence[SecretRule]) -> DataFrame:
        """(blob, findings: array of (rule, spans)) of the blobs in which the given rule versions found something."""
        rows = self.read().where(_one_of(rules) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
        return rows.groupBy("blob").agg(F.collect_list(F.struct("rule", "spans")).alias("findings"))


def _one_of(rules: Sequence[SecretRule]):
    return reduce(or_, [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules], F.lit(False))


def blob_id(text) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: BlobLedger, rules: Sequence[SecretRule] = RULES, key: str = "doc_id", text: str = "text") -> None:
    """Scan the (blob, rule version) pairs that the ledger lacks and append them to it.

    A content moves once: of the rows with an unseen blob only that with the smallest key is read.
    """
    rows = versions.select(F.col(f"`{key}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("content"))
    rows = rows.withColumn("blob", blob_id(F.col("content")))
    carriers = rows.groupBy("blob").agg(F.min("path").alias("first"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger.parts:
        done = ledger.read().where(_one_of(rules)).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        left = F.when(F.col("done").isNull(), names).otherwise(F.array_except(names, "done"))
        carriers = carriers.join(done, "blob", "left").withColumn("todo", left).where(F.size("todo") > 0)
    else:
        carriers = carriers.withColumn("todo", names)
    carriers = carriers.select(F.col("blob").alias("unseen"), "first", "todo")
    chosen = rows.join(carriers, (F.col("blob") == F.col("unseen")) & F.col("path").eqNullSafe(F.col("first")))
    ledger.append(scan_blobs(chosen.select("blob", "content", "todo"), rules))


def scan_versions(versions: DataFrame, ledger: BlobLedger, rules: Sequence[SecretRule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bring the ledger up to date; one row (key, blob, findings) per version, null findings where clean."""
    scan_unseen(versions, ledger, rules, key, text)
    ids = versions.select(F.col(f"`{key}`"), blob_id(F.col(f"`{text}`")).alias("blob"))
    return ids.join(ledger.findings(rules), "blob", "left")


def flat_spans(findings, rules: Sequence[SecretRule]) -> Column:
    """Sorted array of (start, kind number, end, kind); empty for null."""
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])

    def one(f):
        item = lambda s: F.struct(s["start"].alias("start"), number[f["rule"]].alias("k"), s["end"].alias("end"), f["rule"].alias("rule"))
        return F.transform(f["spans"], item)

    return F.array_sort(F.coalesce(F.flatten(F.transform(findings, one)), F.array().cast("array<struct<start:bigint,k:int,end:bigint,rule:string>>")))


def redact(docs: DataFrame, ledger: BlobLedger, rules: Sequence[SecretRule] = RULES, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every finding of the ledger replaced by ``mask``; overlapping findings share one mask.

    Rows without findings stay as they are, null text included. A column ``n_chars`` follows the new text.
    """
    blob, found = fresh(docs, "_blob"), fresh(docs, "_findings")
    hits = ledger.findings(rules).select(F.col("blob").alias(blob), F.col("findings").alias(found))
    joined = docs.withColumn(blob, blob_id(F.col(f"`{text}`"))).join(hits, blob, "left")
    whole = F.col(f"`{text}`")

    def step(a, s):
        inside = s["start"] < a["at"]
        clear = F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], clear, F.lit(mask))).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    end = lambda a: F.concat(a["out"], F.substr(whole, (a["at"] + 1).cast("int")))
    masked = F.when(F.col(found).isNull(), whole).otherwise(F.aggregate(flat_spans(F.col(found), rules), start, step, end))
    new = {c: F.col(f"`{c}`") for c in docs.columns}
    new[text] = masked
    out = joined.select(*[v.alias(c) for c, v in new.items()])
    for c in out.columns:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.length(F.col(f"`{text}`")).cast(docs.schema[c].dataType))
    return out


@query("op6_secret_scans")
def op6(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan_versions(docs, BlobLedger(spark, shared_folder(spark, "blob-ledger")))
    flat = found.select("doc_id", flat_spans(F.col("findings"), RULES).alias("all"))
    count = lambda r: F.size(F.filter("all", lambda x: x["rule"] == r.name)).cast("bigint").alias(f"n_{r.name}")
    parts = F.transform("all", lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string")))
    listed = flat.select("doc_id", *[count(r) for r in RULES], F.concat_ws(",", parts).alias("spans"))
    return listed.withColumn("base_sha256", F.sha2("spans", 256))
