"""WARC archives: write captures as request, response (or revisit) and metadata records, read archives, and
assemble the records of each capture through their WARC-Concurrent-To identifiers.

Null payloads count as empty, null urls leave out the target header, null keys leave out the key field. Rows that
repeat another row are captures of their own. Records that repeat a record id count once. Extra columns are not
read. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm.registry import query, table
from placelens.llm.tables import written
from placelens.session import shared_folder

CRLF = "\r\n"
RECORD_END = CRLF * 2
RECORDS_PER_FILE = 5000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are 20 bits, which are four base32 characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def urn(kind: str, capture: Column) -> Column:
    """Record id that depends on the capture alone, so a task that runs again writes the same ids."""
    h = F.md5(F.concat(F.lit(f"{kind}|"), capture))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}Content-Type: {content_type}{CRLF}"),
        line("WARC-Record-ID", record_id),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        *headers,
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_warc(captures: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write three records per capture into gzip archives under ``folder``.

    Of captures with equal payloads, that with the smallest key is the response and the others revisit it. Only
    one payload per digest is shuffled; the rest of the work runs on keys and digests. Spark's text writer puts
    the record end after each row, so the archives land wherever Spark can write.
    """
    raw = captures.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"))
    raw = raw.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    same = ["digest", "bytes"]
    rows = raw.groupBy("key", "url", *same).agg(F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("n")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", F.col("url").isNull().alias("no_url"), "url", "copy")
    rows = rows.withColumn("order", order)
    rows = rows.withColumn("capture", F.concat_ws("|", text(F.col("key")), text(F.col("url")), "digest", F.col("copy").cast("string")))
    first = rows.groupBy(*same).agg(F.min(F.struct("order", "capture")).alias("first"))
    typed = rows.join(first, same).withColumn("fresh", F.col("order") == F.col("first.order"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    response_id = urn("response", F.col("capture"))
    beside = [F.concat(F.lit("WARC-Concurrent-To: "), response_id, F.lit(CRLF))]
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    path = F.coalesce(uri, F.lit("/"))
    request = _record("request", urn("request", F.col("capture")), uri, beside, "application/http; msgtype=request", F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{RECORD_END}")))
    field = F.coalesce(F.concat(F.lit(f"{key}: "), F.col("key").cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _record("metadata", urn("metadata", F.col("capture")), uri, beside, "application/warc-fields", field)
    response = _record("response", response_id, uri, [digest], "application/http; msgtype=response", F.concat(http, "payload"))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), urn("response", F.col("first.capture")), F.lit(CRLF))
    revisit = _record("revisit", response_id, uri, [digest, refers], "application/http; msgtype=response", http)
    three = lambda main: F.concat_ws(RECORD_END, request, main, metadata).alias("value")
    payloads = raw.groupBy(*same).agg(F.first("payload").alias("payload"))
    full = typed.where("fresh").join(payloads, same).select(three(response))
    light = typed.where(~F.col("fresh")).select(three(revisit))
    writer = full.unionByName(light).write.mode("overwrite").option("lineSep", RECORD_END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


RECORD = "record_id string, type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, payload binary, payload_bytes bigint, payload_sha1 string, fields map<string, string>"
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("target_uri", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_sha1", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)


def parse_archive(content: bytes):
    """Records of one archive, plain or gzip with any number of members; raises on a broken record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("archive ends inside a record header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.lower(), []).append(value.strip())
        length = int(headers["content-length"][0])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("archive ends inside a record block")
        yield headers, block


def _fields(block: bytes) -> list[tuple[str, str]]:
    pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
    return list({k.strip(): v.strip() for k, _, v in pairs}.items())


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``folder``; payloads are those of HTTP responses and resources.

    Without ``payloads`` their sizes and digests are taken from the bytes all the same, and the bytes stay behind.
    """
    fields = [f for f in _ARROW if payloads or f.name != "payload"]
    arrow, batch_rows = pa.schema(fields), 200 if payloads else 5000

    def parse(batches):
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                for headers, block in parse_archive(content.as_py()):
                    get = lambda name: headers.get(name, (None,))[0]  # noqa: E731, B023
                    kind, payload, entries = get("warc-type"), None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if (get("content-type") or "").startswith("application/http") else block
                    elif kind == "resource":
                        payload = block
                    elif kind == "metadata":
                        entries = _fields(block)
                    digest = get("warc-payload-digest")
                    row = [get("warc-record-id"), kind, get("warc-target-uri"), headers.get("warc-concurrent-to", []), get("warc-refers-to"), digest and digest.rpartition(":")[2]]
                    row += [payload] if payloads else []
                    row += [None, None] if payload is None else [len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()]
                    rows.append((*row, entries))
                    if len(rows) >= batch_rows:
                        yield _batch(rows, arrow)
                        rows = []
            if rows:
                yield _batch(rows, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(parse, RECORD if payloads else RECORD.replace("payload binary, ", ""))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response, revisit or resource with its requests and metadata records.

    WARC-Concurrent-To may point either way, and through one record between. Where a record reaches several
    captures, the nearest and then the smallest id owns it. A request or metadata record that reaches none is a
    capture of its own with a null main record. Repeated record ids count once. All but the payloads is written
    once, so archives are not parsed for every step.
    """
    payloads = records.where("payload is not null").select("record_id", "payload") if "payload" in records.columns else None
    records = written(records.drop("payload"), "warc-records")
    rows = records.dropDuplicates(["record_id"])
    is_main = F.col("type").isin("response", "revisit", "resource")
    main, rest = rows.where(is_main), rows.where(~is_main & F.col("type").isin("request", "metadata"))
    links = records.select(F.col("record_id").alias("src"), F.explode("concurrent_to").alias("dst"))
    links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    anchors = main.select(F.col("record_id").alias("anchor"))
    near = links.join(anchors, F.col("dst") == F.col("anchor")).select("src", "anchor")
    via = near.select(F.col("src").alias("mid"), "anchor")
    far = links.join(via, F.col("dst") == F.col("mid")).select("src", "anchor")
    reach = near.withColumn("hops", F.lit(1)).unionByName(far.withColumn("hops", F.lit(2)))
    owner = reach.groupBy("src").agg(F.min(F.struct("hops", "anchor"))["anchor"].alias("anchor"))
    owned = rest.join(owner, F.col("record_id") == F.col("src"), "left").withColumn("capture", F.coalesce("anchor", "record_id"))
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields")))))
    sides = owned.groupBy("capture").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    body = main.drop("concurrent_to", "fields")
    out = body.join(sides, F.col("record_id") == F.col("capture"), "full")
    own = [c for c in body.columns if c != "record_id"]
    out = out.select(F.coalesce("record_id", "capture").alias("capture_id"), *own, "requests", "metadata")
    if payloads is None:
        return out
    unique = payloads.dropDuplicates(["record_id"]).withColumnRenamed("record_id", "capture_id")
    return out.join(unique, "capture_id", "left")


@query("op1_warc_transactions")
def op1(spark, folder):
    archives = shared_folder(spark, "warc")
    write_warc(table(spark, folder, "pages"), archives)
    captures = assemble(read_warc(spark, archives, payloads=False))
    key = F.get(F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda e: e["key"] == "page_id"), F.lit(0))["value"]
    rows = captures.select("capture_id", F.col("type").alias("record_type"), F.col("refers_to").alias("target"), key.cast("bigint").alias("page_id"), "payload_bytes", "payload_sha1")
    full = rows.where(F.col("record_type") == "response")
    known = full.select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_sha1").alias("sha1"))
    # Only revisits have a target; responses stay out of the join.
    again = rows.where(F.col("record_type") == "revisit").join(known, "target", "left")
    out = lambda n, sha1: ["page_id", F.col(n).alias("payload_bytes"), F.col(sha1).alias("payload_digest"), "record_type"]
    return full.select(*out("payload_bytes", "payload_sha1"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        again.select(*out("n", "sha1"), "refers_to")
    )
