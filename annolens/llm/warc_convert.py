"""WARC archives from legacy ARC archives, with identical payloads as revisits.

``write_arc`` makes ARC archives of version 1 (header lines of five fields) or 2 (ten
fields). ``read_arc`` reads the version block of each archive, parses header lines by that
version and takes the declared length of each record. ``convert`` makes WARC records of
them: identifiers from what the record holds, dates from the 14 digits, type response or
revisit, payload digests. ``write_warc`` and ``read_warc`` go to files and back.

Archives are gzip files of one member per record, written by Spark's text sink so that any
file system Spark writes to will do; the sink's line separator is an empty gzip member,
which readers skip. Files are read whole by one task each; their size follows the
partitions written.

Of equal payloads of at least LEAST_BYTES, the record with the smallest page id is the
response. Which pages share a digest is counted without payloads; the records then meet that
table by digest, deflated, and those of very frequent digests meet it without a shuffle by it.

Cases: a null html is an empty payload; a null url becomes ``unknown:``; blanks in urls are
percent-encoded; rows with the same id and payload are both responses; an empty table gives
archives without records; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.llm._common import HOT_SHARE, LEAST_HOT, cut, join_hot

LEAST_BYTES = 100
EPOCH = dt.datetime(2000, 1, 1)
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
NAMESPACE = uuid.NAMESPACE_URL
RECORD = "page_id long, url string, date string, kind string, head binary, payload binary, payload_bytes long, digest string"


def member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: Bytes as a Latin-1 string, the form in which the sink takes its separator.
EMPTY_MEMBER = member(b"").decode("latin-1")


def _save(records: DataFrame, path: str) -> None:
    records.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def write_arc(pages: DataFrame, path: str) -> None:
    """One ARC record for each row of (page_id, url, html); partitions alternate between the versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, offset = 1 + part % 2, f"pages-{part:06d}.arc", 0
        about = f"{version} {1 if version == 1 else 0} annolens\n{FIELDS[version]}\n".encode()
        first = arc_line(version, "filedesc://" + name, "0.0.0.0", EPOCH.strftime("%Y%m%d%H%M%S"), "text/plain", 200, 0, name, len(about)) + about + b"\n"
        yield _values([member(first)])
        for b in batches:
            out = []
            for key, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                payload = (html.as_py() or "").encode()
                page = f"X-Page-Id: {key}\r\n" if key is not None else ""
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                date = (EPOCH + dt.timedelta(seconds=(key or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                record = arc_line(version, _plain(url), "192.0.2.1", date, "text/html", 200, offset, name, len(body)) + body + b"\n"
                offset += len(record)
                out.append(member(record))
            yield _values(out)

    _save(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value binary"), path)


def _values(items: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items, pa.binary())], names=["value"])


def _plain(url: str | None) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "unknown:").encode()).encode("latin-1").decode("utf-8")


def arc_line(version: int, url: str, ip: str, date: str, kind: str, code: int, offset: int, name: str, length: int) -> bytes:
    more = [str(code), "-", "-", str(offset), name] if version == 2 else []
    return (" ".join([url, ip, date, kind, *more, str(length)]) + "\n").encode()


class ArcFault(ValueError):
    """An archive that cannot be read on: where a header line is malformed, nothing says where the next record starts."""


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of one archive: header fields and the ``length`` bytes that the header line declares."""
    try:
        yield from _arc_records(content)
    except (ArcFault, ValueError, EOFError, zlib.error, gzip.BadGzipFile, KeyError) as fault:
        raise ArcFault(str(fault)) from fault


def _arc_records(content: bytes) -> Iterator[dict]:
    f = gzip.GzipFile(fileobj=io.BytesIO(content))
    names: list[str] = []
    while line := f.readline():
        if not line.strip():
            continue
        parts = line.decode().rstrip("\n").split(" ")
        if not names:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("the archive has no version block")
            block = f.read(int(parts[-1]))
            version = int(block.split(b" ", 1)[0])
            names = FIELDS[version].split(" ")
            continue
        if len(parts) != len(names):
            raise ValueError(f"a header line of {len(parts)} fields; version {version} has {len(names)}")
        head = dict(zip(names, parts))
        body = f.read(int(head["Archive-length"]))
        if len(body) != int(head["Archive-length"]):
            raise ValueError("the archive ends inside a record")
        yield {"head": head, "body": body}


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Header bytes with their blank line, entity, and header fields by lower-case name."""
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head + b"\r\n\r\n", payload, {k.lower(): v for k, v in fields.items()}


def _number(x: str | None) -> int | None:
    return int(x) if x is not None else None


def read_arc(spark: SparkSession, path: str, deflate: bool = False) -> DataFrame:
    """page_id, url, date (14 digits), kind, head and payload of every record, with payload_bytes and digest.

    With ``deflate`` payloads are zlib streams, which a later shuffle moves and stores at less than half. Of a
    malformed archive the records before the fault are read; ``rejected_archives`` names it.
    """

    def run(batches):
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for r in _until_fault(content.as_py()):
                    head, payload, fields = split_http(r["body"])
                    h = r["head"]
                    held.append({"page_id": _number(fields.get("x-page-id")), "url": h["URL"], "date": h["Archive-date"], "kind": h["Content-type"], "head": head, "payload": zlib.compress(payload, 1) if deflate else payload, "payload_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()})
                    size += len(payload)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=kinds)

    text, number, raw = pa.string(), pa.int64(), pa.binary()
    kinds = pa.schema([("page_id", number), ("url", text), ("date", text), ("kind", text), ("head", raw), ("payload", raw), ("payload_bytes", number), ("digest", text)])
    return _files(spark, path).mapInArrow(run, RECORD)


def _until_fault(content: bytes) -> Iterator[dict]:
    with contextlib.suppress(ArcFault):
        yield from arc_records(content)


def rejected_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, records, reason) of the archives that end in a fault; ``records`` were read before it."""

    def run(batches):
        for b in batches:
            rows = {"path": [], "records": [], "reason": []}
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                n = 0
                try:
                    for _ in arc_records(content.as_py()):
                        n += 1
                except ArcFault as fault:
                    rows["path"].append(name)
                    rows["records"].append(n)
                    rows["reason"].append(str(fault))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("reason", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, records long, reason string")


def convert(arc: DataFrame) -> DataFrame:
    """``arc`` with ``first``: the page id of the response that a revisit refers to, else null.

    Digests of more than LEAST_HOT records, HOT_SHARE of them at most, are looked up in a broadcast; their
    records take a key of their own in the join of the others, so that no task gets all copies of a page.
    """
    large = arc.where(F.col("payload_bytes") >= LEAST_BYTES)
    firsts = cut(large.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    hot = firsts.where(F.col("n") > LEAST_HOT).orderBy(F.desc("n")).limit(HOT_SHARE).select("digest", F.col("least").alias("hot_least"))
    marked = arc.join(F.broadcast(hot), "digest", "left")
    key = F.when(F.col("hot_least").isNull(), F.col("digest")).otherwise(F.concat_ws("#", F.lit(""), "page_id"))
    joined = marked.withColumn("key", key).join(firsts.select(F.col("digest").alias("key"), "least"), "key", "left")
    least = F.coalesce("hot_least", "least")
    return joined.withColumn("first", F.when(F.col("page_id") != least, least)).drop("least", "hot_least", "key")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_warc(converted: DataFrame, path: str, deflated: bool = False) -> None:
    """WARC records of ``convert``'s rows; ``deflated`` if ``read_arc`` was told to deflate payloads."""

    def run(batches):
        part = TaskContext.get().partitionId()
        about = b"software: annolens\r\nformat: WARC File Format 1.1\r\n"
        info = {"WARC-Record-ID": record_id(None, f"info {part}"), "WARC-Date": EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ"), "Content-Type": "application/warc-fields"}
        yield _values([member(warc_record("warcinfo", info, about))])
        for b in batches:
            out = []
            for r in b.to_pylist():
                date = dt.datetime.strptime(r["date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                fields = {"WARC-Record-ID": record_id(r["page_id"], r["digest"]), "WARC-Date": date, "WARC-Target-URI": r["url"], "WARC-Payload-Digest": f"sha256:{r['digest']}", "Content-Type": "application/http; msgtype=response"}
                if r["first"] is None:
                    out.append(member(warc_record("response", fields, r["head"] + (zlib.decompress(r["payload"]) if deflated else r["payload"]))))
                else:
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(r["first"], r["digest"])}
                    out.append(member(warc_record("revisit", fields, r["head"])))
            yield _values(out)

    _save(converted.select("page_id", "url", "date", "head", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "digest", "first").mapInArrow(run, "value binary"), path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    f = gzip.GzipFile(fileobj=io.BytesIO(content))
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record starts with its version")
        fields = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        yield fields, f.read(int(fields["Content-Length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, record_id, refers_to_id, digest and payload_bytes of every response and revisit; payload is null for revisits.

    A response's digest and length are taken from its payload, and the digest must be the one declared;
    a revisit's come from its header fields.
    """

    def run(batches):
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for fields, block in warc_records(content.as_py()):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    _, payload, http = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not the one declared")
                    full = kind == "response"
                    held.append({"page_id": _number(http.get("x-page-id")), "record_type": kind, "record_id": fields["WARC-Record-ID"], "refers_to_id": fields.get("WARC-Refers-To"), "digest": digest, "payload_bytes": len(payload) if full else int(http["content-length"]), "payload": payload if full else None})
                    size += len(payload)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=kinds)

    text, number = pa.string(), pa.int64()
    kinds = pa.schema([("page_id", number), ("record_type", text), ("record_id", text), ("refers_to_id", text), ("digest", text), ("payload_bytes", number), ("payload", pa.binary())])
    return _files(spark, path).mapInArrow(run, "page_id long, record_type string, record_id string, refers_to_id string, digest string, payload_bytes long, payload binary")


def with_referred(records: DataFrame) -> DataFrame:
    """Replace refers_to_id by ``refers_to``, the page id of the response it names. ``records`` is a written table."""
    responses, revisits = (records.where(F.col("record_type") == k) for k in ("response", "revisit"))
    named = responses.groupBy("record_id").agg(F.min("page_id").alias("refers_to")).withColumnRenamed("record_id", "refers_to_id")
    found = join_hot(revisits, named, "refers_to_id", "left").drop("refers_to_id")
    return responses.drop("refers_to_id").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)
