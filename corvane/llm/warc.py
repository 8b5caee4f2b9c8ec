"""Dictionary-compressed web archives (.warc.zst): writer and reader.

An archive is a leading skippable frame that holds a Zstandard dictionary built from its records, then one frame
per record. Records with equal payloads of at least `min_revisit` bytes are written once: the one with the
smallest page id is the response and the others revisit it. The dictionary of DICT_BYTES is trained on records from all over the archive,
up to TRAINED dictionary sizes of them; the records themselves are always whole.

Null payloads are empty. A null page id is a response that nothing refers to. Rows that repeat the smallest page id
of a payload are all responses. Ids stay in their own type up to the record, where they are text. Archives are bounded by about
`archive_bytes` of payload, but for one larger record; rows that repeat often are dealt over several archives.
An empty table gives no archive. Columns but the named ones are not read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_by_size, utf8

#: Fixed value: magic number of the dictionary's skippable frame in the public .warc.zst specification.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 6 << 20
DICT_BYTES = 32 << 10
#: Dictionary sizes of records that a dictionary is trained on.
TRAINED = 100
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "about:blank" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Trained on every so many-th record, up to TRAINED dictionary sizes; too few for training serve as raw content themselves."""
    sample = [r[:size] for r in records]
    sample = sample[:: max(1, sum(map(len, sample)) // (TRAINED * size))]
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:] or b"WARC/1.1\r\n"


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    raw = dictionary(records)
    codec = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return struct.pack("<II", DICT_MAGIC, len(raw)) + raw + b"".join(map(codec.compress, records))


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; raises on damage."""
    at, codec = 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = data[8:at]
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = codec.decompressobj().decompress(raw)
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    with codec.stream_reader(data[at:], read_across_frames=True) as frames:
        plain = frames.readall()
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = end + 4, int(head["content-length"])
        yield head, plain[start : start + n]
        at = start + n + 4


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = 100) -> DataFrame:
    """archive, n_records, content: archives as rows, a binary column each."""
    payload = utf8(F.col(payload_col))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("payload") + 500), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // archive_bytes))
    rows = rows.withColumn("archive", F.pmod(F.xxhash64("page", "url", "payload"), F.lit(n)))
    # equal rows have one hash: archives that they make too large are dealt into several
    large = rows.groupBy("archive").agg(F.ceil(F.sum(F.octet_length("payload") + 500) / archive_bytes).alias("parts")).where("parts > 2")
    rows = join_by_size(rows, large, ["archive"]).withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # copies meet as narrow rows, summed before the exchange; payloads move once, by archive
    ids = rows.where((F.octet_length("payload") >= min_revisit) & F.col("page").isNotNull()).select("page", "digest", "archive", "parts")
    first = ids.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = ids.join(first, "digest").where("page != first").select("archive", "parts", "page", "digest", "first").distinct()
    revisits = revisits.select(F.col("archive").alias("known_archive"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("long"))).alias("part"), F.col("page").alias("known_page"), F.col("digest").alias("known_digest"), "first")
    schema = pa.schema([("archive", pa.int64()), ("n_records", pa.int64()), ("content", pa.binary())])

    def build(records: pa.Table, known: pa.Table) -> pa.Table:
        if not len(records):
            return schema.empty_table()
        refers = dict(zip(zip(known.column("known_page").to_pylist(), known.column("known_digest").to_pylist()), known.column("first").to_pylist()))
        columns = zip(*(records.column(c).to_pylist() for c in ("page", "url", "payload", "digest")))
        out = [record(page, url, body, digest, refers.get((page, digest))) for page, url, body, digest in columns]
        return pa.table([[records.column("archive")[0].as_py()], [len(out)], [archive(out)]], schema=schema)

    rows = rows.select("archive", F.col("part").cast("long").alias("part"), "page", "url", "payload", "digest")
    return rows.groupBy("archive", "part").cogroup(revisits.groupBy("known_archive", "part")).applyInArrow(build, "archive long, n_records long, content binary")


def read(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives; a response's digest is checked against its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in records_of(content.as_py()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = head["warc-payload-digest"].partition(":")[2]
                    if head["warc-type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"the payload of {head['warc-record-id']} does not fit its digest")
                    ident, to = (head.get(k, "")[len("<urn:page:") : -1] or None for k in ("warc-record-id", "warc-refers-to"))
                    rows.append((ident, head["warc-target-uri"], size, digest, head["warc-type"], to, body if head["warc-type"] == "response" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    out = archives.select("content").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
