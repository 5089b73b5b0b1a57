"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages with equal payloads are found on digests alone (no payload is shuffled for
it); of each group of at least `min_bytes` the smallest page_id is stored as `response`, the
others as `revisit` that refer to it. Tasks write archives straight to the shared folder
under names of their own, so that a task that is run again leaves no half archive in use:
only archives named in the manifest, which Spark commits, are read.

Reading: a task streams an archive, loads its dictionary, decodes frame by frame, and checks
the version line, the mandatory headers, both lengths, the record's end and the digests.
Memory is bounded by one record.

Null html is an empty payload. A null page_id never is the smallest one, unless a group has
no other; then all its rows are responses. Repeated rows of the smallest page_id all are
responses. Empty tables give no archives and no records. Other columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder
from .common import hash_sample

SKIPPABLE = 0x184D2A5D  # magic number of the dictionary frame
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 64 << 20  # an archive is closed when it has grown beyond this
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 256, 16 << 10, 32 << 10  # bounds of the dictionary's sample
LEVEL = 3

MANIFEST = "path string, records long, bytes long"
RECORDS = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
           "payload_digest string, refers_to long")
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


class Damaged(ValueError):
    """An archive that breaks the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """File system and path inside it; every scheme that pyarrow knows, local paths included."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def record_id(page_id: int | None, number: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{number}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record; `first` is the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if first is None else "revisit"
    block = http + payload if first is None else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if first is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", str(first))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A row of `RECORDS` from one decoded frame."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Damaged("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise Damaged(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Damaged(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged("length of the block")
    block = rest[:size]
    if fields.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
        raise Damaged("digest of the block")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise Damaged("no HTTP response")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise Damaged("payload")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise Damaged("revisit")
    first = fields.get("x-refers-to-page-id")
    page = fields.get("x-page-id")
    return {"page_id": None if page is None else int(page), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest,
            "refers_to": None if first is None else int(first)}


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive; the dictionary comes from the leading skippable frame, if there is one."""
    import zstandard

    held, decoder, first = b"", zstandard.ZstdDecompressor(), True
    while True:
        while len(held) < 8 and (more := stream.read(chunk)):
            held += more
        if not held:
            return
        if len(held) < 8:
            raise Damaged("cut off")
        magic, size = struct.unpack("<II", held[:8])
        if magic == SKIPPABLE and first:
            while len(held) < 8 + size and (more := stream.read(chunk)):
                held += more
            if len(held) < 8 + size:
                raise Damaged("cut off")
            words = held[8 : 8 + size]
            if words[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
                words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
            decoder, held, first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), held[8 + size :], False
            continue
        first = False
        if magic != FRAME:
            raise Damaged(f"frame magic {magic:#x}")
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = stream.read(chunk)
            if not held:
                raise Damaged("cut off")
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, html: str) -> bytes:
    """A dictionary from a bounded sample: the first `SAMPLE_PAGES` pages in hash order, `SAMPLE_BYTES` of each.

    It only helps compression; with too few pages there is none.
    """
    import zstandard

    body = F.col(f"`{html}`").cast("binary")
    rows = hash_sample(pages.where(body.isNotNull()).select(body.alias("all")), F.col("all"), SAMPLE_PAGES).select(F.substring("all", 1, SAMPLE_BYTES).alias("b")).collect()
    samples = [bytes(r["b"]) for r in rows if r["b"]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, page_id: str = "page_id",
                   url: str = "url", html: str = "html") -> DataFrame:
    """Write `pages` as archives under `folder` (default: the shared folder); returns the manifest."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    words = train_dictionary(pages, html)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    small = rows.select("page_id", "sha1", F.length("payload").alias("n"))
    groups = (small.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
              .where((F.col("copies") > 1) & F.col("first").isNotNull()))
    revisits = (small.join(groups, ["sha1", "n"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
                .select(F.col("page_id").alias("of"), F.col("sha1").alias("with"), "first").distinct())
    marked = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["of"]) & (rows["sha1"] == revisits["with"]), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(words) if words else None
        if known:
            known.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        out, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path, size, count = f"{folder}/part-{uuid.uuid4().hex}.warc.zst", 0, 0
                    store, place = filesystem(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place)
                    if words:
                        size += out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
                page, address, payload, sha1, first = (batch.column(k)[i].as_py() for k in range(5))
                digest = base64.b32encode(sha1).decode()
                size += out.write(packer.compress(record(page, address, payload, digest, first)))
                count += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         ["path", "records", "bytes"])

    return cut(marked.select("page_id", "url", "payload", "sha1", "first").mapInArrow(write, MANIFEST))


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in `manifest`, checked; without `payloads` their bytes stay in the task."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = filesystem(path)
                held, size, seen = [], 0, 0
                with store.open_input_stream(place) as stream:
                    for raw in frames(stream):
                        row = parse(raw)
                        if not payloads:
                            row["payload"] = None
                        seen += 1
                        held.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, ARROW)
                            held, size = [], 0
                if seen != expected:
                    raise Damaged(f"{path}: {seen} records, the manifest has {expected}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, ARROW)

    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("path", "records").repartition(tasks).mapInArrow(read, RECORDS)
