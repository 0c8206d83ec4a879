"""WARC: conversion of legacy ARC archives.

An ARC file starts with a version block, whose first line names the version and whose second names the fields of every later header line;
after each header line come as many bytes as it declares. The reader goes by those fields and lengths alone. Each ARC record becomes a WARC/1.1
record: an identifier made from the ARC file and the offset, the 14-digit date as an ISO timestamp, a type (response for http, resource for
other schemes, warcinfo for the version block, revisit for a payload that another record keeps), and digests of block and payload.

Archives are written and read by Spark alone, so that they can lie in any store: a row is one whole archive of bounded size, written as one
gzip-compressed file, and read again as one binary row. Of records with equal payloads of at least `least` bytes, that of the smallest
row id keeps the payload; only digests, ids and lengths are shuffled to find it, summed up in each task first, and what a file's records
refer to goes to the file by its name: to where the archives are read if there are few such records (counted), else archives and
records meet in a shuffle (a bounded number of records per file).

Defined results: a null payload is empty; a null row id never keeps a payload for others with an id (it sorts last); a null url becomes
"urn:row:<id>"; blanks and control characters in a url are percent-encoded, as a header line is split at blanks. Rows that repeat an id and a payload
give a record each; of those only one keeps the payload. An empty table gives no archive and an empty result. A record larger than `target`
bytes gets an archive of its own. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import broadcast_if_small, materialise, scratch, struct_of, tidy

#: The header fields of the two published versions of the ARC format.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
CRLF = b"\r\n"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


# --- ARC ---


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 vaultspark\n{ARC_FIELDS[version]}\n".encode()
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, name: str, offset: int, ip: str = "0.0.0.0") -> bytes:
    more = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"{url} {ip} {date} {mime} {more}{len(block)}\n".encode() + block


class ArcError(ValueError):
    """The bytes are no ARC archive of a known version."""


def read_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record, the version block first. Fields are taken from the ends of a header line, since old
    writers left blanks in urls: all fields after the url have none."""
    names: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ArcError(f"a header line at {at} has no end")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        if not names:
            parts = line.split(" ")
            length = int(parts[-1])
            block = data[stop + 1 : stop + 1 + length]
            head = block.decode("utf-8", "replace").split("\n")
            version = head[0].split(" ")[0]
            if not line.startswith("filedesc:") or not version.isdigit() or int(version) not in ARC_FIELDS or len(head) < 2:
                raise ArcError("no version block of a known version")
            names = head[1].strip().split(" ")
            fields = dict(zip(ARC_FIELDS[1 if len(parts) == 5 else 2].split(" "), parts, strict=False)) | {"version": version}
        else:
            parts = line.rsplit(" ", len(names) - 1)
            if len(parts) != len(names) or not parts[-1].isdigit():
                raise ArcError(f"the header line at {at} doesn't have the declared fields")
            fields = dict(zip(names, parts, strict=True))
            length = int(fields["Archive-length"])
            block = data[stop + 1 : stop + 1 + length]
        if len(block) != length:
            raise ArcError(f"the record at {at} declares {length} bytes and has {len(block)}")
        yield at, fields, block
        at = stop + 1 + length


# --- WARC ---


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)


def _head_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{file}#{offset}')}>"


def iso_date(arc: str) -> str:
    """14 digits, or fewer as some writers left, as a timestamp."""
    d = (re.sub(r"\D", "", arc) + "00010101000000"[len(re.sub(r"\D", "", arc)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, rid: str, date: str, block: bytes, **fields: str | None) -> bytes:
    """Without the two line ends that close a record."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    head |= {"WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + CRLF + block


def convert(file: str, data: bytes, refers: dict[int, tuple[str, int | None]]) -> bytes:
    """One ARC archive as one WARC archive, without the last record's closing line ends. refers: offset -> the record that keeps the payload."""
    out = []
    for offset, fields, block in read_arc(data):
        rid, date = record_id(file, offset), iso_date(fields["Archive-date"])
        if "version" in fields:
            said = f"software: vaultspark\r\nformat: WARC File Format 1.1\r\ndescription: from ARC version {fields['version']}\r\n".encode()
            out.append(warc_record("warcinfo", rid, date, said, WARC_Filename=fields["URL"].removeprefix("filedesc://"), Content_Type="application/warc-fields"))
            continue
        web = fields["URL"].startswith(("http://", "https://"))
        head, payload = http_parts(block)
        digest = "sha256:" + hashlib.sha256(payload).hexdigest()
        common = {"WARC_Target_URI": fields["URL"], "WARC_IP_Address": fields["IP-address"], "WARC_Payload_Digest": digest}
        mime = "application/http; msgtype=response" if web or head else fields["Content-type"]
        if offset in refers:
            keeper, row = refers[offset]
            out.append(warc_record("revisit", rid, date, head, **common, Content_Type=mime, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=keeper, X_Refers_To_Row=None if row is None else str(row)))
        else:
            out.append(warc_record("response" if web or head else "resource", rid, date, block, **common, Content_Type=mime))
    return b"\r\n\r\n".join(out)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        length = int(head["Content-Length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) != length or data[stop + 4 + length : stop + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it declares")
        yield head, block
        at = stop + 8 + length


# --- in Spark ---


def _write(archives: DataFrame, path: str, end: str) -> None:
    """Each row's bytes, and `end` after them, as one gzip file."""
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", target: int = 4 << 20, date: str = "20200101000000") -> None:
    """The rows as ARC archives of some `target` bytes each, by turns of version 1 and 2: an HTTP response each, its row id in a head field."""
    out = to_arrow_schema(struct_of("archive binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        used = 0

        def name() -> tuple[str, int]:
            return f"rows-{part:06d}-{made:06d}.arc", 1 + made % 2

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts)], type=pa.binary())], schema=out)

        for batch in batches:
            cols = batch.to_pydict()
            for row, url, payload in zip(cols["row"], cols["url"], cols["payload"], strict=True):
                body = payload or b""
                if parts and used + len(body) > target:
                    yield done()
                    made, parts, used = made + 1, [], 0
                file, version = name()
                if not parts:
                    parts.append(arc_version_block(file, version, date))
                    used = len(parts[0]) + 1
                where = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:row:{row}"
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if row is None else f"X-Row-Id: {row}\r\n") + f"Content-Length: {len(body)}\r\n\r\n"
                parts.append(arc_record(version, where, date, "text/html", head.encode() + body, file, used))
                used += len(parts[-1]) + 1
        if parts:
            yield done()

    rows = pages.selectExpr(f"cast(`{id_col}` as bigint) as row", f"cast(`{url_col}` as string) as url", f"cast(`{payload_col}` as binary) as payload")
    _write(rows.mapInArrow(tidy(run), "archive binary"), path, "\n")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 100, max_broadcast: int = 200_000) -> None:
    """Every ARC archive under arc_path as a WARC archive under warc_path. At most max_broadcast revisits (counted) travel to the archives; of more, the archives are joined to theirs."""
    arcs = _read(spark, arc_path)
    seen_schema = "path string, offset long, row long, digest binary, n long, rid string"
    seen_out = to_arrow_schema(struct_of(seen_schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = []
                file = path.rpartition("/")[2]
                for offset, fields, block in read_arc(gzip.decompress(content)):
                    if "version" not in fields:
                        head, payload = http_parts(block)
                        row = _head_field(head, b"X-Row-Id")
                        rows.append((path, offset, None if row is None else int(row), hashlib.sha256(payload).digest(), len(payload), record_id(file, offset)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), seen_out, strict=True)], schema=seen_out)

    seen = arcs.mapInArrow(tidy(scan), seen_schema).where(F.col("n") >= least)
    order = F.struct(F.col("row").isNull().alias("late"), "row", "rid")
    keepers = seen.groupBy("digest").agg(F.min(order).alias("keeper"), F.count("*").alias("k")).where("k > 1").select("digest", "keeper")
    revisits = seen.join(keepers, "digest").where(F.col("rid") != F.col("keeper.rid"))
    revisits = revisits.select("path", "offset", F.col("keeper.rid").alias("rid"), F.col("keeper.row").alias("row"))
    few, small = broadcast_if_small(materialise(spark, revisits, "warc-revisits"), max_broadcast)
    by_file = few.groupBy("path").agg(F.collect_list(F.struct("offset", "rid", "row")).alias("refers"))
    by_file = F.broadcast(by_file) if small else by_file
    out = to_arrow_schema(struct_of("archive binary"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, refers in zip(*(batch[c].to_pylist() for c in ("path", "content", "refers")), strict=True):
                made = convert(path.rpartition("/")[2], gzip.decompress(content), {r["offset"]: (r["rid"], r["row"]) for r in refers or ()})
                if made:  # Spark writes an empty file where there are no rows
                    yield pa.RecordBatch.from_arrays([pa.array([made], type=pa.binary())], schema=out)

    _write(arcs.join(by_file, "path", "left").select("path", "content", "refers").mapInArrow(tidy(turn), "archive binary"), warc_path, "\r\n\r\n")


SCHEMA = "row long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string"


def read_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """One row per record but warcinfo ones. A revisit's digest and length are those that it states of the payload that another record keeps."""
    out = to_arrow_schema(struct_of(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"].to_pylist():
                rows = []
                for head, block in read_warc(gzip.decompress(content)):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = http_parts(block)
                    row, to = _head_field(http, b"X-Row-Id"), head.get("X-Refers-To-Row")
                    if kind == "revisit":
                        n, digest = int(_head_field(http, b"Content-Length") or 0), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    else:
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((None if row is None else int(row), head.get("WARC-Target-URI"), "response" if kind == "resource" else kind, n, digest, None if to is None else int(to), head["WARC-Record-ID"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return _read(spark, warc_path).mapInArrow(tidy(run), SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows to ARC archives, those to WARC archives, and these read again."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc, id_col, url_col, payload_col)
    convert_arc(spark, arc, warc)
    return read_records(spark, warc)
