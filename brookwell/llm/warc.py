"""WARC archives: records written in segments, read back and reassembled.

Writing: each page becomes an HTTP response whose body is framed in chunks; a
block longer than ``segment_bytes`` is cut into a first record and continuations.
Of pages with equal payloads of at least ``least_bytes``, the one with the largest
id is the response and the others are revisits that refer to it. Tasks write
gzip-per-record archives to the shared folder under names of their own attempt,
and only the archives of committed attempts enter the manifest.

Reading: each archive is read once, by one task of as many as there are archives.
Records that were not cut are decoded there; segments are grouped by their origin
identifier and ordered by segment number, and the total length is verified. The
chunked transfer framing is decoded and the payload checked against the declared
digest. A group is one payload.

Defined cases: a null payload is empty; a null id or url has no header and comes
back null (the largest id among null ids is null); equal ids with equal payloads
are told apart by their place in the input, which must be stable (a file scan, a
written table); an empty table gives no archive and no rows; a record whose
segments are missing (the first included), repeated or of the wrong length, whose
framing is broken or whose digest differs comes back with ``intact`` false and
null payload columns; a very long payload is one row, as it was in the input;
other columns are not looked at, whatever their names.
"""

import gzip
import hashlib
import io
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwell.llm.work import LEAST_HOT, MOST_HOT, attach, work_path, written

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record string, page string, type string, origin string, segment int, total long, refers_to string, digest string, block binary"
MOST_READERS = 50_000


def record_id(uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(uid))}>"


def chunked(payload: bytes, size: int = 4096) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            if CRLF not in body[at:]:
                raise ValueError("no end of chunks")
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk's length is wrong")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None), b"Content-Length: %d" % len(block)]
    return gzip.compress(CRLF.join(lines) + CRLF * 2 + block + CRLF * 2, 1, mtime=0)


def page_records(uid: int, page: str | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    rid, digest = record_id(uid), "sha1:" + hashlib.sha1(payload).hexdigest()
    target = None if url is None else " ".join(url.split())
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    base = {"WARC-Record-ID": rid, "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": digest, "X-Page-ID": page, "Content-Type": "application/http;msgtype=response"}
    if refers_to is not None:
        yield record({"WARC-Type": "revisit"} | base | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}, head + CRLF)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record({"WARC-Type": "response"} | base, block)
        return
    yield record({"WARC-Type": "response"} | base | {"WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{uid}/{k}')}>", "WARC-Date": DATE, "WARC-Target-URI": target, "X-Page-ID": page, "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": k} | last, part)


def plan_revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(uid, page, url, payload, refers_to): refers_to is the uid of the equal payload that stays the response."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    numbered = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = numbered.select("uid", "page", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= least_bytes)
    kept = digests.groupBy("digest").agg(F.max(F.struct("page", "uid")).alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("kept.uid").alias("kept_uid"), "n")
    kept = written(kept, "equal-payloads")
    limit = max(LEAST_HOT, pages.count() // MOST_HOT)
    often = kept.where(F.col("n") > limit).select(F.col("d").alias("often"), F.col("kept_uid").alias("often_uid"))  # fewer than MOST_HOT rows
    alone = F.concat(F.lit("alone"), F.col("uid"))
    keyed = numbered.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")).otherwise(alone)).join(F.broadcast(often), F.col("digest") == F.col("often"), "left")
    keyed = keyed.withColumn("digest", F.when(F.col("often").isNull(), F.col("digest")).otherwise(alone))
    met = keyed.join(kept.where(F.col("n") <= limit), F.col("digest") == F.col("d"), "left").withColumn("kept_uid", F.coalesce("often_uid", "kept_uid"))
    return met.select("uid", F.col("page").cast("string").alias("page"), "url", "payload", F.when(F.col("kept_uid") != F.col("uid"), F.col("kept_uid")).alias("refers_to"))


def write_archives(planned: DataFrame, path: str, segment_bytes: int = 8192, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write the records below ``path``; the written manifest (archive, records, bytes) lists what was committed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, archives, out, n, size = "", [], None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(archives):04d}.warc.gz"
                    out, n, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                for data in page_records(row["uid"], row["page"], row["url"], row["payload"], row["refers_to"], segment_bytes):
                    out.write(data)
                    n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    archives.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            archives.append((name, n, size))
        names, records, sizes = zip(*archives, strict=True) if archives else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{x}" for x in names], pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return written(planned.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def parse_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip stream."""
    data = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := data.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := data.readline()) not in (CRLF, b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = data.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("the archive ends inside a record")
        yield headers, block


def _archive_rows(path: str) -> Iterator[tuple]:
    """The fields of RECORD for each record of an archive."""
    number = lambda x: None if x is None else int(x)
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as raw:
        for h, block in parse_archive(raw):
            yield h.get("warc-record-id"), h.get("x-page-id"), h.get("warc-type"), h.get("warc-segment-origin-id"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), h.get("warc-refers-to"), h.get("warc-payload-digest"), block


def _by_archive(manifest: DataFrame) -> DataFrame:
    """The archives' names, dealt to as many tasks as there are archives (at most MOST_READERS)."""
    return manifest.select("archive").repartition(max(1, min(MOST_READERS, manifest.count())))


def read_records(manifest: DataFrame) -> DataFrame:
    """The archives' records as rows; one archive, of bounded size, is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("page", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = _archive_rows(path)
                while some := list(itertools.islice(rows, 500)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return _by_archive(manifest).mapInArrow(run, RECORD)


def payload_of(segments: list[tuple[int | None, bytes]], total: int | None, digest: str | None) -> bytes | None:
    """The payload of a response's segments in order; None if anything doesn't fit."""
    numbers = [n for n, _ in segments]
    if numbers != ([None] if numbers == [None] else list(range(1, len(numbers) + 1))):
        return None
    block = b"".join(b for _, b in segments)
    if numbers != [None] and total != len(block):
        return None
    head, gap, body = block.partition(CRLF * 2)
    if not gap:
        return None
    try:
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None
    return payload if digest in (None, "sha1:" + hashlib.sha1(payload).hexdigest()) else None


PAYLOAD = "record string, page string, type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def _decoded(kind: str | None, segments: list[tuple[int | None, bytes]], total: int | None, digest: str | None) -> tuple:
    """(payload_bytes, payload_digest, intact, payload) of a record."""
    payload = payload_of(segments, total, digest) if kind == "response" else None
    if payload is None:
        return None, None, kind == "revisit", None
    return len(payload), hashlib.sha1(payload).hexdigest(), True, payload


def reassemble(records: DataFrame) -> DataFrame:
    """(record, page, type, refers_to, payload_bytes, payload_digest, intact, payload) for each response and revisit.

    Only responses are cut, so segments whose first is lost are a response.
    """
    single = records.where("segment IS NULL").select("record", "page", "type", "refers_to", "digest", F.array(F.struct("segment", "block")).alias("segments"), "total")
    parts = records.where("segment IS NOT NULL").withColumn("record", F.coalesce("origin", "record"))
    first = lambda c: F.max(F.when(F.col("origin").isNull(), F.col(c)))
    grouped = parts.groupBy("record").agg(
        F.max("page").alias("page"), F.coalesce(first("type"), F.lit("response")).alias("type"), first("refers_to").alias("refers_to"), first("digest").alias("digest"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"), F.max("total").alias("total"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_decoded(row["type"], [(s["segment"], s["block"]) for s in row["segments"]], row["total"], row["digest"]) for row in batch.select(["type", "digest", "segments", "total"]).to_pylist()]
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([g[k] for g in got], t) for k, t in enumerate(kinds))], ["record", "page", "type", "refers_to", "payload_bytes", "payload_digest", "intact", "payload"])

    return single.unionByName(grouped).mapInArrow(run, f"{PAYLOAD}, payload binary")


def read_payloads(manifest: DataFrame) -> DataFrame:
    """``reassemble`` without the payloads, in one pass over the archives: what was not cut is decoded by the task that reads it, and only segments are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("page", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = _archive_rows(path)
                while some := list(itertools.islice(rows, 500)):
                    out = [(*r, None, None, None) if r[4] is not None else (*r[:8], None, *_decoded(r[2], [(None, r[8])], r[5], r[7])[:3]) for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    read = written(_by_archive(manifest).mapInArrow(run, f"{RECORD}, payload_bytes long, payload_digest string, intact boolean"), "records")
    columns = [c.split()[0] for c in PAYLOAD.split(", ")]
    return read.where("segment IS NULL").select(*columns).unionByName(reassemble(read.where("segment IS NOT NULL").drop("payload_bytes", "payload_digest", "intact")).select(*columns))


def resolve(read: DataFrame, id_type: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact): revisits take the payload of the response that they refer to."""
    read = written(read.select("record", "page", "type", "refers_to", "payload_bytes", "payload_digest", "intact"), "payloads")
    revisits = read.where("type = 'revisit'")
    responses = read.where("type = 'response'").select(F.col("record").alias("r"), F.col("page").alias("r_page"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest"), F.col("intact").alias("r_intact"))
    targets = written(revisits.groupBy("refers_to").agg(F.count("*").alias("n")).join(responses, F.col("refers_to") == F.col("r"), "left"), "targets")
    met = attach(revisits.select("page", "type", "refers_to"), targets, ["refers_to"], "n", read.count())
    revisits = met.select("page", F.col("r_bytes").alias("payload_bytes"), F.col("r_digest").alias("payload_digest"), "type", F.col("r_page").alias("refers"), F.coalesce("r_intact", F.lit(False)).alias("intact"))
    plain = read.where("type = 'response'").select("page", "payload_bytes", "payload_digest", "type", F.lit(None).cast("string").alias("refers"), "intact")
    return plain.union(revisits).select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers").cast(id_type).alias("refers_to"), "intact")


def round_trip(spark: SparkSession, pages: DataFrame, segment_bytes: int = 8192, least_bytes: int = 1000) -> DataFrame:
    """Write the pages' records, then read the archives back."""
    manifest = write_archives(plan_revisits(pages, least_bytes), work_path(spark, "warc"), segment_bytes)
    return resolve(read_payloads(manifest), pages.schema["page_id"].dataType.simpleString())
