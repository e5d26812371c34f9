"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. A reading task has a range of
bytes; it looks for the gzip magic, takes a place for a member only if it
unpacks to a WARC header and to the end of the member (its checksum holds), and owns
the records that start inside its range, also where they end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored
from .files import NewFile, at

#: Payloads from this size on are stored once.
LEAST = 1000
#: A file is closed when it has so many bytes; a reading task gets so many.
FILE_BYTES, SPLIT_BYTES = 1 << 30, 16 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORDS = (
    "file string, offset bigint, record_type string, record_id string, refers_to string, "
    "target_uri string, digest string, length bigint, payload binary"
)


def with_revisits(pages: DataFrame, least: int = LEAST, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, sha1, original: original is the id of the page whose record this one revisits.

    Of pages with equal payloads of at least ``least`` bytes, the one with the
    largest id is stored. A null html is empty. A null id is smaller than any; rows that
    repeat the largest id are stored each.
    """
    rows = pages.select(
        F.col(id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    )
    # smaller payloads can't match and stay where they are
    large = rows.filter(F.octet_length("payload") >= least)
    small = rows.filter(F.octet_length("payload") < least).withColumn("original", F.lit(None).cast("bigint"))
    large = large.withColumn("content", F.concat(F.octet_length("payload").cast("string"), F.lit(":"), F.sha2("payload", 256)))
    first = large.groupBy("content").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    rows = large.join(first.filter("n > 1").drop("n"), "content", "left").drop("content").unionByName(small)
    original = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), original.alias("original"))


def _record(page, url, payload: bytes, sha1: str, original) -> bytes:
    def name(i: int | None) -> str:
        return "<urn:page:none>" if i is None else f"<urn:page:{i}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if original is not None:
        head += [f"WARC-Refers-To: {name(original)}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` as archives in ``folder``: file, n_bytes, n_records of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, out, n = TaskContext.get().partitionId(), 0, None, 0

        def closed():
            size = out.finish()
            name = out.path.rsplit("/", 1)[1]
            return pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [size], "n_records": [n]})

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out, n = NewFile(folder, f"part-{task:06d}-{nth:04d}.warc.gz"), 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(_record(*[c[i].as_py() for c in batch.columns])) + packer.flush())
                n += 1
                if out.size >= file_bytes:
                    yield closed()
                    out, nth = None, nth + 1
        if out is not None:
            yield closed()

    return stored(pages.mapInArrow(write, "file string, n_bytes bigint, n_records bigint"), "archives")


class _Range:
    """Bytes of a file from ``start`` on, read on as far as a record needs."""

    def __init__(self, f, start: int, end: int, size: int):
        self.f, self.start, self.size = f, start, size
        self.data = bytearray(f.read_at(min(end, size) - start, start))

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.data += self.f.read_at(min(1 << 20, self.size - at), at)
        return True


def _member(data: _Range, place: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``place`` holds and where it ends; None if there is no WARC record."""
    unpack, out, begin = zlib.decompressobj(31), bytearray(), place
    try:
        while not unpack.eof:
            if begin >= len(data.data) and not data.more():
                return None
            chunk = bytes(data.data[begin : begin + (1 << 16)])
            out += unpack.decompress(chunk)
            begin += len(chunk)
            if len(out) >= 5 and out[:5] != b"WARC/":
                return None
    except zlib.error:
        return None
    return (bytes(out), begin - len(unpack.unused_data)) if out[:5] == b"WARC/" else None


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _parsed(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = block[: int(fields.get("content-length", len(block)))]
    http = {}
    if fields.get("content-type", "").startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = _fields(top)
    revisit = fields.get("warc-type") == "revisit"
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "target_uri": fields.get("warc-target-uri"),
        "digest": digest if revisit else hashlib.sha1(block).hexdigest(),
        "length": int(http.get("content-length", 0)) if revisit else len(block),
        "payload": None if revisit else block,
    }


def records_in(f, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Offset and fields of the records of an open file that start in [start, end)."""
    size = f.size()
    # two bytes more: a magic may begin on the last bytes of the range
    data = _Range(f, start, min(end + 2, size), size)
    place = 0
    while True:
        place = data.data.find(MAGIC, place)
        if place < 0 or data.start + place >= end:
            return
        if (found := _member(data, place)) is None:
            place += 1
            continue
        yield data.start + place, _parsed(found[0])
        place = found[1]
        if place > 4 << 20:  # forget what lies behind
            del data.data[:place]
            data.start, place = data.start + place, 0


def ranges(files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """file, start: the ranges of all archives, dealt to as many partitions (of at least 1 MiB together).

    The number is given: Spark sees only the bytes of the names and would merge all into one task.
    """
    count = files.agg(F.sum(F.ceil(F.col("n_bytes") / max(split, 1 << 20)))).first()[0] or 1
    start = F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, F.lit(split).cast("bigint"))
    return files.select("file", F.explode(start).alias("start")).repartition(int(count))


def read_warc(files: DataFrame, folder: str, split: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives: file, offset and the fields of ``RECORDS``.

    ``files`` has file and n_bytes. A revisit has no payload, but the digest
    and length of the one it stands for. Records of other types come with
    their block as payload. What is no WARC member is passed over.
    """
    parts = ranges(files, split)
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("record_type", "record_id", "refers_to", "target_uri", "digest")], ("length", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = at(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with store.open_input_file(f"{root}/{file}") as f:
                    for offset, record in records_in(f, start, start + split):
                        rows.append({"file": file, "offset": offset, **record})
                        held += len(record["payload"] or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return parts.mapInArrow(read, RECORDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and size of a response are those of the payload that was read. An empty table has no
    archive and gives an empty table. Columns other than page_id, url and html are not read, whatever their names.
    """
    folder = new_path(pages.sparkSession, "warc")
    files = write_warc(with_revisits(pages), folder)

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, "^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("bigint")

    return read_warc(files, folder).select(
        page("record_id").alias("page_id"),
        F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
