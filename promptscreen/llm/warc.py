"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive is a file of Zstandard frames: first a skippable frame (magic
0x184D2A5D) that holds the dictionary, then one frame for each record. Records have
the fields that WARC 1.1 asks for; ids are unique, and what the standard has no field for
(a page's id, the page that a revisit refers to, the length of the whole payload) is in fields that begin with X-.

Files are committed by Spark's own text writer, on whatever store the folder is, and a task that runs again leaves
nothing behind; no executor opens a file itself. That writer copies the bytes of a value
as they are. A row is a run of frames, and the line separator an empty skippable frame, so the whole
file is valid Zstandard. An archive has ARCHIVE_RUNS runs of about RUN_BYTES at most, and a record goes whole to one run: archives are
bounded in bytes, but for a single record that is longer.

Defined results. A null html is an empty payload. Payloads under MIN_REVISIT
bytes are always responses. Rows with the same page_id and payload are all
responses if theirs is the smallest page_id of the payload; a null page_id sorts
last, and comes back null. A null url comes back null; any other comes back as it was. An empty table gives no records.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, new_path, small_batches

#: Fixed values of the format.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: An empty skippable frame as text: its magic 0x184D2A50 and the length 0, little-endian.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 100
#: The dictionary is built from so many whole records at most, of so many bytes together; longer ones than LONGEST gain nothing from one.
SAMPLE_RECORDS, SAMPLE_BYTES, LONGEST, DICT_BYTES = 1024, 8 << 20, 1 << 18, 65_536
#: Compressed bytes of a run of records, and runs of an archive. A reader holds one archive.
RUN_BYTES, ARCHIVE_RUNS = 1 << 20, 16
LEVEL, CHUNK = 3, 16_384
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def shown(text: str) -> str:
    """A value as a field can hold it: itself, or encoded where it has what a field has not."""
    return text if text and not CONTROL.search(text) and not text.startswith("base64:") else "base64:" + base64.b64encode(text.encode("utf-8", "surrogatepass")).decode()


def meant(field: str | None) -> str | None:
    if field is None or not field.startswith("base64:"):
        return field
    return base64.b64decode(field[7:]).decode("utf-8", "surrogatepass")


def record(name: uuid.UUID, date: str, page_id: str | None, url: str | None, digest: str, size: int, kind: str, refers: str | None, refers_url: str | None, payload: bytes) -> bytes:
    """A WARC 1.1 record; a revisit has no payload, only what identifies it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    # A URI has no white space or control characters; one that does is written encoded, and as it was beside that.
    plain = lambda u: CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", u)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {plain(url) if url else 'urn:none'}"]
    if not url or shown(url) != url:
        head.append("X-Target-URI: " + ("none" if url is None else shown(url)))
    if page_id is not None:
        head.append(f"X-Page-ID: {shown(page_id)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {shown(refers or '')}"]
        if refers_url:
            head.append(f"WARC-Refers-To-Target-URI: {plain(refers_url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def target(fields: dict[str, str]) -> str | None:
    """The url that a record was made with."""
    own = fields.get("X-Target-URI", fields["WARC-Target-URI"])
    return None if own == "none" and "X-Target-URI" in fields else meant(own)


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sampled records; raw content where there is too little to train on; none for no records."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, by its embedded dictionary."""
    at, plain = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICT_MAGIC and size:
                plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
        elif magic == ZSTD_MAGIC:
            one, out = plain.decompressobj(), []
            while not one.eof:
                if at >= len(data):
                    raise ValueError("the archive ends within a record")
                out.append(one.decompress(data[at : at + CHUNK]))
                at += len(data[at : at + CHUNK])
            at -= len(one.unused_data)
            yield b"".join(out)
        else:
            raise ValueError(f"no frame at byte {at}")


def classify(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, and its url and html.

    First pages are a grouped minimum, of which each task sends a row for a
    payload, so that a payload that a third of the pages share costs no more.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    ids = hashed.select("page_id", "url", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= MIN_REVISIT)
    low = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    first = ids.groupBy("payload_digest").agg(low.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("payload_digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return hashed.join(first, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


def sample_of(records: DataFrame, total: int) -> list:
    """Whole records for the dictionary, by a hash of page and url: no more than SAMPLE_RECORDS and, in order of the hash, SAMPLE_BYTES."""
    short = records.where(F.col("payload_bytes") <= LONGEST)
    sampled = bounded_sample(short, SAMPLE_RECORDS, total, "page_id", "url").withColumn("k", F.xxhash64("page_id", "url"))
    left, last = SAMPLE_BYTES, None
    for k, size in sorted(sampled.select("k", "payload_bytes").collect()):
        left -= size
        if left < 0:
            break
        last = k
    return [] if last is None else sampled.where(F.col("k") <= last).collect()


def write_archives(records: DataFrame, path: str, total: int | None = None, date: datetime.datetime | None = None) -> None:
    """Writes classified pages as archives, each of one partition's pages. total: their number, if it is known; date: when they were taken, now if not given."""
    spark = records.sparkSession
    stamp = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    job = uuid.uuid4()
    names = ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "refers_to_url", "html"]
    rows = records.select(*[F.col(c).cast("string") if c in ("page_id", "refers_to") else F.col(c) for c in names])

    def row_bytes(r, name: uuid.UUID) -> bytes:
        text = lambda x: x if isinstance(x, str) else None  # noqa: E731 - pandas has NaN for null
        return record(name, stamp, text(r.page_id), text(r.url), r.payload_digest, int(r.payload_bytes), r.record_type, text(r.refers_to), text(r.refers_to_url), r.html.encode("utf-8", "surrogatepass"))

    # Samples are for the dictionary alone; the archives hold every payload whole.
    sampled = sample_of(rows, records.count() if total is None else total)
    dictionary = spark.sparkContext.broadcast(train([row_bytes(r, job) for r in sampled]))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = dictionary.value
        how = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        part, n, made = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        size = 0

        def run() -> pd.DataFrame:
            nonlocal held, size, made
            lead = b"" if made % ARCHIVE_RUNS else dictionary_frame(raw)
            out = pd.DataFrame({"frames": [lead + b"".join(held)]})
            held, size, made = [], 0, made + 1
            return out

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                frame = how.compress(row_bytes(r, uuid.uuid5(job, f"{part}/{n}")))
                n += 1
                if held and size + len(frame) > RUN_BYTES:
                    yield run()
                held.append(frame)
                size += len(frame)
        if held:
            yield run()

    runs = small_batches(rows).mapInPandas(compress, "frames binary").select(F.col("frames").cast("string").alias("value"))
    runs.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_RUNS).text(path)


def read_archives(spark, path: str, id_type: str = "long") -> DataFrame:
    """Records of archives: page_id (as id_type), url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The digest of each response is made anew from its payload; one that differs from its header's raises.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                out, held = [], 0
                for data in frames(content):
                    h, payload = parse(data)
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {h['WARC-Record-ID']} differs")
                    out.append((meant(h.get("X-Page-ID")), target(h), int(h["X-Payload-Length"]), digest, kind, meant(h.get("X-Refers-To-Page")), payload))
                    held += len(payload)
                    if held > 8 << 20:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=columns)

    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(decode, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Archives pages under path and returns the records read back."""
    write_archives(classify(pages), path, pages.count())
    return read_archives(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, archived in the shared folder and read back."""
    read = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM h),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
