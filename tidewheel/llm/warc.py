"""WARC archives compressed with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of whole records, stands in a leading skippable
frame of every archive, and each record is a frame of its own compressed with it, so any
record can be read alone.  Where the sample is too little to train on, the dictionary is
empty and so is the frame.  Records with equal payloads of at least ``min_bytes`` are
written once as a response; the others are revisits that name it.

Payloads are digested in the JVM first, so only digests and ids are grouped, and only
responses are compressed.  While the repeated digests fit a broadcast (``BROADCAST_DIGESTS``
of them) no payload moves at all; beyond that compressed frames do, those of the few most
repeated digests excepted.  Each task writes archives of bounded size into the shared folder,
under names of its own attempt; the manifest that is kept lists the files that count, so a
lost or repeated task leaves nothing half-read.

Defined cases: null html is an empty payload; null URLs write no target; rows with a null
id can be a response only when no row with an id has their payload; rows that share the
smallest id of a payload are all responses; an empty table writes no archive.  Control
characters in URLs are percent-encoded in headers.  A payload of any length is one record,
held by one task while it is written, and may exceed an archive's size, which then holds it
alone.  Further columns of the table are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._files import opened, written
from tidewheel.llm._session import cut, fresh_folder, partitions
from tidewheel.llm._skew import attach

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the RFC's for URLs

#: Records (about), and their bytes (at most), that the dictionary is trained on.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 512, 32 << 20, 65536, 3
ARCHIVE_BYTES = 64 << 20
#: Repeated digests that are broadcast at most (about a hundred bytes each).
BROADCAST_DIGESTS = 500_000
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def build_record(kind: str, page_id: int | None, url: str | None, digest: str, length: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1" or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def train_dictionary(pages: DataFrame, digests: DataFrame, records: int, size: int) -> bytes:
    """From whole pages with different payloads, drawn by hash of id and digest at the rate that gives
    about SAMPLE_RECORDS of them or SAMPLE_BYTES, and of these, in order of the hash, as many as
    SAMPLE_BYTES hold: the same ones however the table is dealt out.  Empty where they are too few."""
    import zstandard

    whole = 1 << 40
    rate = min(1.0, SAMPLE_RECORDS / max(1, records), SAMPLE_BYTES / max(1, size))
    mark = F.pmod(F.xxhash64("page_id", "sha1"), F.lit(whole))
    drawn = digests.where((F.col("n") > 0) & (mark < F.lit(int(whole * rate)))).groupBy("sha1").agg(F.min(F.struct(mark.alias("h"), "page_id", "n")).alias("r"))
    chosen, held = [], 0
    for sha1, (_, page_id, n) in sorted(drawn.collect(), key=lambda r: (r["r"]["h"], r["sha1"])):  # about SAMPLE_RECORDS
        if held + n <= SAMPLE_BYTES:
            chosen.append((page_id, sha1))
            held += n
    if not chosen:
        return b""
    wanted = pages.sparkSession.createDataFrame(chosen, "id long, digest string")
    met = pages.join(F.broadcast(wanted), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("digest")))
    rows = met.groupBy("sha1").agg(F.min(F.struct("page_id", "url", "html")).alias("r")).select("r.*").collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
    samples = []
    for page_id, url, html in rows:
        payload = html.encode()
        samples.append(build_record("response", page_id, url, sha1_base32(payload), len(payload), payload))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few records to train on
        return b""


@lru_cache(maxsize=4)
def _codec(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held), zstandard.ZstdDecompressor(dict_data=held)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """(id, url, html) -> manifest of the archives written: path, records, bytes."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    digests = cut(pages.select("page_id", "sha1", F.octet_length("html").cast("long").alias("n")))
    records, size = digests.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages, digests, records, size))
    repeated = digests.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    repeated = cut(repeated.where("times > 1 and first is not null"))
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")

    def compress(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _codec(shared.value)[0]
        for frame in frames:
            rows = []
            for page_id, url, html, sha1, first in zip(*(frame[c] for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                page_id = None if pd.isna(page_id) else int(page_id)
                payload, data = html.encode(), None
                if pd.isna(first):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    data = coder.compress(build_record("response", page_id, url, digest, len(payload), payload))
                rows.append((page_id, url, sha1, len(payload), data, None if pd.isna(first) else int(first)))
            yield pd.DataFrame(rows, columns=["page_id", "url", "sha1", "n", "frame", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    shape = "page_id long, url string, sha1 string, n long, frame binary, refers_to long"
    if repeated.count() <= BROADCAST_DIGESTS:
        known = pages.join(F.broadcast(repeated.drop("times")), "sha1", "left").select("page_id", "url", "html", "sha1", refers_to)
        marked = known.mapInPandas(compress, shape)
    else:
        ready = pages.withColumn("refers_to", F.lit(None).cast("long")).mapInPandas(compress, shape).drop("refers_to")
        marked = attach(ready, repeated, ["sha1"], "times", records, "left").select("page_id", "url", "sha1", "n", "frame", refers_to)

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, head = _codec(shared.value)[0], struct.pack("<II", SKIPPABLE_MAGIC, len(shared.value)) + shared.value

        def flow() -> Iterator[bytes]:
            for frame in frames:
                for page_id, url, sha1, n, data, refers_to in zip(*(frame[c] for c in ("page_id", "url", "sha1", "n", "frame", "refers_to"))):
                    if pd.isna(refers_to):
                        yield data
                    else:
                        page_id = None if pd.isna(page_id) else int(page_id)
                        digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                        yield coder.compress(build_record("revisit", page_id, url, digest, int(n), b"", int(refers_to)))

        records = flow()
        data = next(records, None)
        while data is not None:
            uri, count, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, len(head)
            with written(uri) as out:
                out.write(head)
                while data is not None and (not count or size + len(data) <= ARCHIVE_BYTES):
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    data = next(records, None)
            yield pd.DataFrame([(uri, count, size)], columns=["path", "records", "bytes"])

    return cut(marked.mapInPandas(store, "path string, records long, bytes long"))


def frames_of(source: io.BufferedIOBase) -> tuple[bytes, Iterator[bytes]]:
    """(dictionary, record after record) of one archive, read as a stream."""
    import zstandard

    head = source.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = source.read(size)
    decoder = _codec(dictionary)[1]

    def records() -> Iterator[bytes]:
        data = source.read(1 << 16)
        while data:
            one, parts = decoder.decompressobj(), []
            while not one.eof:
                if not data:
                    raise zstandard.ZstdError("archive ends within a record")
                parts.append(one.decompress(data))
                data = one.unused_data if one.eof else source.read(1 << 16)
            if not data:
                data = source.read(1 << 16)
            yield b"".join(parts)

    return dictionary, records()


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and,
    if asked for, the payload (null for revisits).  Payloads are checked against their digests."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
        whole = {"page_id": "Int64", "refers_to": "Int64"}
        for frame in frames:
            for path in frame["path"]:
                with opened(path) as source:
                    rows, held = [], 0
                    for data in frames_of(source)[1]:
                        record = parse_record(data)
                        h = record["headers"]
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and sha1_base32(record["payload"]) != digest:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
                        number = lambda k: int(h[k]) if k in h else None
                        row = (number("X-Page-Id"), h.get("WARC-Target-URI"), int(record["http"]["Content-Length"]), digest, h["WARC-Type"], number("X-Refers-To-Page-Id"))
                        rows.append(row + ((record["payload"] if h["WARC-Type"] == "response" else None),) * payloads)
                        held += len(data) * payloads + 200
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names).astype(whole)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype(whole)

    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    spread = manifest.select("path").repartition(partitions(manifest.sparkSession, 8), "path")
    return spread.mapInPandas(read, shape)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_folder(pages.sparkSession, "warc"), min_bytes))
