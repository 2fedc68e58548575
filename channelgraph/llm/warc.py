"""Web archives: records in, gzip members out, and a reader that salvages what it can from damaged files.

Writing: each task writes its records into files of bounded size in a shared folder, one gzip member a record, and
returns a row per finished file. These rows are a manifest that Spark commits; a file of a lost or repeated task is in no
manifest and is never read. Reading: each file is walked member by member (or record by record where it is not
compressed). Where a check fails - gzip checksum, version line, header, length, digest - the reader searches on for the
next place at which a whole valid record starts, goes on from there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from channelgraph.llm.common import documents, scratch_path, settle, utf8

VERSION = b"WARC/1.1"
#: A file is closed once it has this many bytes.
ROLL_BYTES = 8 << 20
#: Smaller payloads are written again rather than referred to.
REVISIT_BYTES = 100
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Checksum of the header lines before it, for records that have it; it stands last.
HEAD_CHECK = "X-Head-Check"
START, PLAIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n"), re.compile(rb"WARC/1\.[01]\r\n")
FED = 4096


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    uri = re.sub(r"[\x00-\x20\x7f]+", "%20", url) if url else f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisits else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisits:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page", str(refers_to)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8")
    return text + f"{HEAD_CHECK}: {zlib.crc32(text):08x}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def parse_record(data: bytes | memoryview, at: int) -> tuple[Record, int]:
    """The record that starts at ``at`` and the place after it. ValueError where a check fails."""
    data_bytes = data if isinstance(data, bytes) else bytes(data)
    end = data_bytes.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("no end of header")
    lines = data_bytes[at:end].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    said = headers.get(HEAD_CHECK.lower())
    if said is not None and said != f"{zlib.crc32(data_bytes[at : end - len(lines[-1])]):08x}":
        raise ValueError("header check differs")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data_bytes[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where it says")
    block = data_bytes[start:stop]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and said.startswith("sha256:") and said[7:] != hashlib.sha256(payload).hexdigest():
        raise ValueError("payload digest differs")
    return Record(headers, payload), stop + 4


def _content(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, the place after it, and where it is damaged the reason; the content then
    goes as far as it could be read."""
    unzip, parts, fed = zlib.decompressobj(31), [], at
    while not unzip.eof:
        if fed >= len(data):
            return b"".join(parts), fed, "member is cut short"
        try:
            parts.append(unzip.decompress(data[fed : fed + FED]))
        except zlib.error as wrong:
            again = zlib.decompressobj(31)
            parts = [again.decompress(data[at:fed])]
            with contextlib.suppress(zlib.error):
                for i in range(fed, fed + FED):
                    parts.append(again.decompress(data[i : i + 1]))
            return b"".join(parts), fed, str(wrong)
        fed = min(fed + FED, len(data))
    return b"".join(parts), fed - len(unzip.unused_data), None


def _records_at(data: bytes, at: int) -> tuple[list[Record | str], int, str | None]:
    """The records of the member at ``at`` (the plain record there), the place after it, and the reason where the member
    is damaged. ValueError where there is none.

    Stretches of a sound member that are given up stand as reasons between its records. Of a damaged member only records
    with a block digest count, as the member's own checksum does not speak for the others.
    """
    if data[at : at + 2] != b"\x1f\x8b":
        record, end = parse_record(data, at)
        return [record], end, None
    raw, end, wrong = _content(data, at)
    rows = list(_walk(raw, lambda d, a: ([(r := parse_record(d, a))[0]], r[1], None), PLAIN))
    if wrong is None:
        got = [f"{one}: bytes {a} to {b} of the member's content" if isinstance(one, str) and len(rows) > 1 else one for a, b, one in rows]
    else:
        got = [one for _, _, one in rows if isinstance(one, Record) and one.headers.get("warc-block-digest", "").startswith("sha256:")]
    if not any(isinstance(one, Record) for one in got):
        raise ValueError(wrong or (got[0] if got else "member is empty"))
    return got, end, wrong


def _walk(data: bytes, records_at: Callable, places: re.Pattern) -> Iterator[tuple[int, int, Record | str]]:
    at = given_up = 0
    reason = None  # of the bytes from given_up on
    while at < len(data):
        try:
            got, end, wrong = records_at(data, at)
        except ValueError as failed:
            got, wrong = [], str(failed)
        if got and at > given_up:
            yield given_up, at, reason
        if got:
            for one in got[:-1]:
                yield at, at, one
            yield at, at if wrong else end, got[-1]
            given_up, reason = at, None
        if wrong is None:
            at = given_up = end
            continue
        reason = wrong if reason is None else reason
        found = places.search(data, at + 1)
        at = found.start() if found else len(data)
    if at > given_up:
        yield given_up, at, reason


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(start, end, record) of every valid record, and (start, end, reason) of the bytes given up between them.

    Files may hold gzip members, plain records, or both. A damaged stretch is left at the first later place where a
    record passes all its checks; a valid record that stands inside the damaged one's payload would be taken for a record.
    A member may hold any number of records; its content is held whole. All its rows have its start; the last one has its
    end, the others end where they start. Records of a damaged member stand so before the row of the bytes given up.
    """
    yield from _walk(data, _records_at, START)


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records to write: page_id, url, html, digest, revisits, refers_to.

    Of equal payloads of at least ``least`` bytes the row with the smallest id is the response and the others refer to
    it; null ids come last, and of fully repeated rows one is the response. Null html is an empty payload.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest")
    )
    large = rows.filter(F.octet_length("html") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    by_id = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    groups = large.groupBy("digest").agg(F.min(by_id).alias("first"), F.sum("n").alias("n")).filter("n > 1")
    groups = settle(groups.select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("first_id")), "warc-groups")
    # which of fully repeated rows is the first
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    joined = rows.withColumn("_nth", nth).join(groups, F.col("digest") == F.col("_digest"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("_nth") == 1)
    revisits = F.col("_digest").isNotNull() & ~is_first
    return joined.select("page_id", "url", "html", "digest", revisits.alias("revisits"), F.when(revisits, F.col("first_id")).alias("refers_to"))


def _write(folder: str, compress: bool, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, size, count, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, size, count))
                out = None

        for batch in batches:
            html = utf8(batch.column("html"))
            rest = zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "revisits", "refers_to")], strict=True)
            for payload, (page_id, url, digest, revisits, refers_to) in zip(html, rest, strict=True):
                record = record_bytes(page_id, url, payload.as_py(), digest, revisits, refers_to)
                if compress:
                    record = member(record)
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(record)
                size, count = size + len(record), count + 1
                if size >= roll:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["file", "bytes", "records"])

    return run


def write_archives(records: DataFrame, folder: str, compress: bool = True, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes the files and returns their manifest (file, bytes, records), itself kept in ``folder``."""
    spark = records.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/files")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    records = records.select("page_id", "url", "html", "digest", "revisits", "refers_to")
    manifest = records.mapInArrow(_write(f"{folder}/files", compress, roll), "file string, bytes long, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


READ = "file string, start long, end long, gap string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(with_payload: bool):
    def number(text: str | None) -> int | None:
        return int(text) if text is not None and text.lstrip("-").isdecimal() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in READ.split(", ")])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for start, end, got in salvage(content.as_py()):
                    row = dict.fromkeys(names) | {"file": file, "start": start, "end": end}
                    if isinstance(got, str):
                        row["gap"] = got
                    else:
                        h = got.headers
                        row |= {"record_type": h.get("warc-type"), "page_id": number(h.get("x-page-id")), "url": h.get("warc-target-uri")}
                        row |= {"payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to": number(h.get("x-refers-to-page"))}
                        row["payload_bytes"] = len(got.payload) if row["record_type"] == "response" else number(h.get("x-payload-length"))
                        if with_payload:
                            row["payload"] = got.payload
                            held += len(got.payload)
                    rows.append(row)
                    if len(rows) >= 4096 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """Every record of the files that the manifest names (all files without one), and a row with ``gap`` set for each
    stretch of bytes that was given up: file, start, end, and for records the fields of READ."""
    files = spark.read.format("binaryFile").load(f"{folder}/files")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    if manifest is not None:
        files = files.join(manifest.select("file"), "file", "left_semi")
    return files.select("file", "content").mapInArrow(_read(with_payload), READ)


def op9_salvage_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages and reads the archives back."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(with_revisits(documents(spark, sf_dir, "pages")), folder)
    records = read_archives(spark, folder, manifest)
    return records.filter("gap IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
