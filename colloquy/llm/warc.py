"""WARC: write archives and an index, then read records back by sorted byte ranges.

Index first: every record's offset, length, URL and digest go to a table as its
archive is written. Reading takes any selection of index rows, gathers those that
lie in the same stretch of a file, sorts them by offset, fetches neighbouring
records with one range read and parses them.

Archives lie in a folder that driver and executors share, reached through
pyarrow's filesystems (file, s3, hdfs, gs). A task attempt writes files of its
own names; the index only lists those of attempts that Spark committed, so a
lost executor leaves at most an archive that nothing refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import shared_dir, stash, table
from colloquy.llm.kernels import fewer

ARCHIVE_BYTES = 64 << 20
STRETCH_BYTES = 8 << 20
GAP_BYTES = 64 << 10
URN = "urn:colloquy:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {id}, file string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"


def open_dir(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """file:/x, file:///x, s3://... or a plain path."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, first_id, response: bool, date: str) -> bytes:
    """One gzip member. A revisit has the HTTP head only, with the payload's length in it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if response else head
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if not response:
        fields += [("WARC-Refers-To", f"<{URN}{'' if first_id is None else first_id}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one gzip member."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, first_id: of pages with equal payloads of at least ``least`` bytes the smallest page_id.

    Only digests that occur more than once are joined. They are written first, so
    that the join has a plain shuffle on either side: Spark then splits a hot digest,
    with the html of all its copies, over several tasks.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.when(F.octet_length(html) >= least, F.sha1(html)).alias("_sha"))
    firsts = keyed.groupBy("_sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _sha IS NOT NULL").select("_sha", "first_id")
    firsts = stash(firsts)
    return keyed.join(firsts.hint("merge"), "_sha", "left").select("page_id", "url", "html", F.coalesce("first_id", "page_id").alias("first_id"))


def write(pages: DataFrame, uri: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives of about archive_bytes to uri; returns their index, which is a table on disk.

    A null html is an empty payload, a null url an empty one. Rows that share
    the smallest page_id of their payload are all written as responses. A page
    without id can only be a response if its payload is nowhere else.
    """
    spark = pages.sparkSession
    decided = decide(pages, least)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, base = open_dir(uri)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in fewer(batches, 500):
                rows = []
                for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id")), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html.encode()
                    digest = digest_of(payload)
                    response = page_id == first
                    data = record(page_id, url, payload, digest, first, response, date)
                    out.write(data)
                    rows.append((page_id, name, at, len(data), url, digest, "response" if response else "revisit"))
                    at += len(data)
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = [batch.column("page_id").type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "file", "offset", "length", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return stash(decided.mapInArrow(run, INDEX.format(id=kind)))


def read(index: DataFrame, uri: str, *, payloads: bool = True) -> DataFrame:
    """The records that the rows of index name, with their payloads (null for revisits, or if not asked for).

    The rows of one stretch of a file go to one task, sorted by offset; a stretch
    is of fixed size, so what goes together is bounded whatever the selection.
    Neighbours are fetched with one range read of about a stretch at most. Checks
    every response against its digest.
    """
    spark = index.sparkSession
    kind = index.schema["page_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    # by number, as few rows stand for much reading
    plan = index.select("file", stretch.alias("stretch"), "offset", "length", "page_id", "url").repartition(parts, "file", "stretch").sortWithinPartitions("file", "offset")

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, base = open_dir(uri)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        file, source = None, None
        try:
            for batch in batches:
                id_type = batch.schema.field("page_id").type
                types = [id_type, pa.string(), pa.string(), id_type, pa.int64(), pa.string(), pa.binary()]
                for group in ranges(batch.to_pylist()):
                    if group[0]["file"] != file:
                        if source is not None:
                            source.close()
                        file = group[0]["file"]
                        source = fs.open_input_file(f"{base}/{file}")
                    begin = group[0]["offset"]
                    data = source.read_at(group[-1]["offset"] + group[-1]["length"] - begin, begin)
                    for a in range(0, len(group), 500):
                        rows = []
                        for m in group[a : a + 500]:
                            fields, http, payload = parse(data[m["offset"] - begin : m["offset"] - begin + m["length"]])
                            response = fields["WARC-Type"] == "response"
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if response and digest_of(payload) != digest:
                                raise ValueError(f"{file} at {m['offset']}: the payload isn't what its digest says")
                            refers = None if response else ident(fields["WARC-Refers-To"], id_type)
                            rows.append((ident(fields["WARC-Record-ID"], id_type), m["url"], fields["WARC-Type"], refers, int(http["Content-Length"]), digest, payload if response and payloads else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        finally:
            if source is not None:
                source.close()

    return plan.mapInArrow(run, RECORD.format(id=kind))


def ranges(records: list[dict]) -> Iterator[list[dict]]:
    """Groups of sorted records of one file that are read at once: gaps of at most GAP_BYTES, about STRETCH_BYTES in all."""
    group: list[dict] = []
    for r in records:
        last = group[-1] if group else r
        if group and (r["file"] != last["file"] or r["offset"] > last["offset"] + last["length"] + GAP_BYTES or r["offset"] - group[0]["offset"] >= STRETCH_BYTES):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def ident(text: str, kind: pa.DataType):
    found = text.strip("<>").removeprefix(URN)
    return None if not found else (int(found) if pa.types.is_integer(kind) else found)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark)
    index = write(table(spark, sf_dir, "pages"), uri)
    return read(index, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)"
OP5_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id, sha1(coalesce(html, '')) AS h FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {_BASE32}), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""
