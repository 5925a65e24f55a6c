"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, one frame for each record.

write_archives() lays page rows out as archives of bounded size through Spark's own writer, so any store that Spark
can write serves; read_archives() reads them (or others of the same form) through Spark's binary-file source. The
reader loads the dictionary, decodes one frame at a time, and checks version line, mandatory headers, Content-Length
against the block, the record's end, the frame holding just one record, the inner HTTP length and the payload digest;
what is wrong with a record stands in its `error`. Where a frame cannot be read, one row says so, and reading goes on at
the next place at which a frame decodes to a WARC version line, so damage costs no sound record behind it. An archive is
one row of work in one task: keep third-party archives under Spark's 2 GB limit for a binary value.

Defined cases: a null payload is empty; of equal payloads of at least min_bytes the row with the largest page_id is the
response and the others revisit it; rows that repeat that page_id are all responses; a group without any page_id has
responses only; a null page_id or url has a record of its own form. Control characters of a url are percent-encoded.
A named field that a record repeats is an error, but for WARC-Concurrent-To. An empty table gives no archive and no rows;
columns of pages beyond page_id, url and html are ignored, whatever their names.
"""

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import per_batch, shared_dir, table

# Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: An empty skippable frame, all of it ASCII: the writer's record separator, and legal between Zstandard frames.
GAP = struct.pack("<II", SKIPPABLE, 0)

RECORD = (
    "file string, frame_offset bigint, record_id string, record_type string, target_uri string, date string, "
    "refers_to_id string, payload_digest string, payload_bytes bigint, payload binary, error string"
)


def record_id(page_id) -> str:
    """A version-8 UUID that carries the 64 bits of the id, or says that there is none."""
    bits = (page_id or 0) & 0xFFFFFFFFFFFFFFFF
    value = (int(page_id is None) << 127) | (8 << 76) | ((bits >> 62) << 64) | (2 << 62) | (bits & ((1 << 62) - 1))
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_id(record: str | None):
    """The id that record_id() put in; null for none."""
    if not record or not (m := re.fullmatch(r"<urn:uuid:([0-9a-f-]{36})>", record)):
        return None
    value = uuid.UUID(m[1]).int
    if value >> 127:
        return None
    bits = (((value >> 64) & 3) << 62) | (value & ((1 << 62) - 1))
    return bits - (1 << 64) if bits >> 63 else bits


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, own: str, uri: str, date: str, payload: bytes, refers: str | None) -> bytes:
    """The bytes of a response record, or of a revisit record, which keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def trained(samples: list[bytes], size: int):
    """A dictionary from the samples, or None where they are too few or too small for one."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=128, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], dictionary_bytes: int = 16 << 10, sample: int = 256) -> bytes:
    """One archive; the dictionary is fitted on its first `sample` records (a bound of the model, not of the data)."""
    fitted = trained(records[:sample], dictionary_bytes)
    out = []
    if fitted:
        raw = zstandard.ZstdCompressor(level=3).compress(fitted.as_bytes())
        out += [struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw]
    encoder = zstandard.ZstdCompressor(level=3, dict_data=fitted, write_checksum=True)
    out += [encoder.compress(r) for r in records]
    return b"".join(out)


def write_archives(pages: DataFrame, at: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 32 << 20, min_bytes: int = 0, broadcast_rows: int = 500_000) -> None:
    """Archives of up to about archive_bytes of records each in the folder `at`, one record for each row (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload"))
    groups = keyed.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    groups = table(groups, "payload_groups")
    if groups.count() <= broadcast_rows:  # 40 bytes a row; beyond that a shuffled join, whose hot keys adaptive execution splits
        groups = F.broadcast(groups)
    joined = keyed.join(groups, "sha", "left").select("page_id", "url", "payload", F.expr("case when keeper is not null and page_id is distinct from keeper then keeper end").alias("keeper"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for own, url, payload, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = "urn:scholion:none" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                held.append(record("revisit" if keeper is not None else "response", record_id(own), uri, date, payload, None if keeper is None else record_id(keeper)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["content"])

    made = per_batch(joined, run, "content binary").select(F.col("content").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("lineSep", GAP.decode()).mode("overwrite").text(at)


def _decoded(view, at: int, fitted, enough: int | None = None):
    """(bytes, where the frame ends, what is wrong) of the frame at a place, or its first `enough` bytes."""
    decoder, out, fed, step, size = zstandard.ZstdDecompressor(dict_data=fitted).decompressobj(), [], at, 4096, 0
    try:
        while not decoder.eof and fed < len(view):
            out.append(decoder.decompress(view[fed : fed + step]))
            size += len(out[-1])
            if enough is not None and size >= enough:
                return b"".join(out)[:enough], None, None
            fed, step = min(fed + step, len(view)), min(step * 2, 1 << 20)
    except zstandard.ZstdError as e:
        return None, None, f"frame: {e}"
    return (b"".join(out), fed - len(decoder.unused_data), None) if decoder.eof else (None, None, "truncated frame")


def _next_record(view, at: int, fitted) -> int:
    """The next place from `at` on at which a frame decodes to a WARC version line; the end if there is none."""
    for m in re.compile(re.escape(struct.pack("<I", FRAME_MAGIC))).finditer(view, at):
        if (_decoded(view, m.start(), fitted, 7)[0] or b"")[:7] == b"WARC/1.":
            return m.start()
    return len(view)


def frames(content):
    """(offset, bytes of the frame or None, what is wrong) of an archive; the dictionary is loaded on the way."""
    view, at, fitted = memoryview(content), 0, None
    while at < len(view):
        raw = wrong = end = None
        magic, size = struct.unpack_from("<II", view, at) if len(view) - at >= 8 else (0, 0)
        if len(view) - at < 8:
            wrong = "truncated frame header"
        elif magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(view):
                wrong = "truncated skippable frame"
            else:
                if magic == DICTIONARY_MAGIC and at == 0:
                    raw = bytes(view[8 : 8 + size])
                    try:
                        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                            raw = zstandard.ZstdDecompressor().decompress(raw)
                        fitted = zstandard.ZstdCompressionDict(raw)
                    except (zstandard.ZstdError, ValueError) as e:
                        yield at, None, f"dictionary: {e}"
                at += 8 + size
                continue
        elif magic != FRAME_MAGIC:
            wrong = "not a Zstandard frame"
        else:
            raw, end, wrong = _decoded(view, at, fitted)
        yield at, raw, wrong
        at = _next_record(view, at + 1, fitted) if wrong else end


def headers(raw: bytes, once: bool = False) -> dict[str, str]:
    """Fields by lower-case name; once: whether a repeated one is an error."""
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line[:40]!r}")
        if once and name.lower() in out and name.lower() != "warc-concurrent-to":
            raise ValueError(f"repeated {name.lower()}")
        out[name.lower()] = value.strip()
    return out


def parse(frame: bytes) -> dict:
    """The fields of the one record in a frame; the first thing that is wrong with it is in `error`."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "date", "refers_to_id", "payload_digest", "payload_bytes", "payload", "error"))
    try:
        head, found, rest = frame.partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        if not found or not re.fullmatch(rb"WARC/1\.[01]", version):
            raise ValueError("no WARC version line or end of headers")
        h = headers(lines, once=True)
        out |= {"record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to_id": h.get("warc-refers-to"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        if missing := [k for k in MANDATORY if k not in h]:
            raise ValueError(f"no {missing[0]}")
        if not h["content-length"].isdigit():
            raise ValueError("Content-Length is not a number")
        size = int(h["content-length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"Content-Length {size}, but {len(rest) - 4} bytes before the end of the frame")
        block = rest[:size]
        if h.get("content-type", "").startswith("application/http"):
            http, found, payload = block.partition(b"\r\n\r\n")
            if not found:
                raise ValueError("no end of the HTTP header")
            inner = headers(http.partition(b"\r\n")[2]) if b"\r\n" in http else {}
            stated = inner.get("content-length", "")
            if out["record_type"] == "revisit":
                out["payload_bytes"] = int(stated) if stated.isdigit() else None
                if h.get("warc-profile") == REVISIT and not out["refers_to_id"]:
                    raise ValueError("a revisit without WARC-Refers-To")
            else:
                out |= {"payload": payload, "payload_bytes": len(payload)}
                if stated.isdigit() and int(stated) != len(payload):
                    raise ValueError(f"HTTP Content-Length {stated}, but {len(payload)} bytes")
        else:
            out |= {"payload": block, "payload_bytes": size}
        if out["payload"] is not None and out["payload_digest"] and out["payload_digest"] != digest(out["payload"]):
            raise ValueError("the payload has another digest")
    except ValueError as e:
        out["error"] = str(e)
    return out


def read_archives(spark: SparkSession, at: str, payload: bool = True) -> DataFrame:
    """One row for each frame of the archives in the folder `at` (see RECORD); without payload that column is null."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, frame, error in frames(content.as_buffer()):
                    row = {"error": error} if frame is None else parse(frame)
                    rows.append(row | {"file": path, "frame_offset": offset} | ({} if payload else {"payload": None}))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    SCHEMA = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, RECORD.split(", "), strict=True)])
    return per_batch(spark.read.format("binaryFile").load(at).select("path", "content"), run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Page rows written as archives to the shared folder and read back, with page ids for record ids."""
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/warc"
    write_archives(pages, at)
    records = read_archives(spark, at, payload=False)

    def ids(batches):
        for batch in batches:
            own, refers = ([page_id(x) for x in batch.column(i).to_pylist()] for i in (0, 4))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns[1:4], pa.array(refers, pa.int64()), batch.column(5)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"])

    return per_batch(records.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id", "error"), ids, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, error string")
