"""Web archives inside ZIP packages, written and range-read without extraction.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, whose records
are separate gzip members, and ``indexes/index.cdxj``, one line a record. A reader fetches the end
of the file, follows the end-of-central-directory record (and its ZIP64 locator where a field is
saturated) to the central directory, finds the data start of each stored member behind its local
header, reads the index, and then fetches runs of neighbouring records by byte range.

Writers put packages into the shared scratch folder under a name of their own and report them; only
reported packages are read, so a failed or repeated attempt leaves nothing that counts.

Defined results: a null payload is empty; null ids and URLs come back as null and all others as they
were, but that control characters of a URL (and white space at its ends) are percent-encoded; of records with equal
payloads of at least ``min_bytes`` bytes that with the largest id is the response and the others
revisit it (rows that repeat that id are responses too; records without an id are responses where no
equal record has one); an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import join_lookup, whole
from weft.runtime import materialize, scratch_path, ship, shuffle_partitions

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A package is closed at this size; a range read covers about so many bytes.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: What a header field cannot hold: control characters and line ends, and white space at its ends.
_CONTROL = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]|^\s+|\s+$")
_RECORD_SCHEMA = "record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, *, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One gzip member that holds a WARC record; a revisit keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    target = [] if uri is None else [f"WARC-Target-URI: {_CONTROL.sub(lambda m: quote(m[0]), uri)}"]
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *target, f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP header fields and payload of one gzip member."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": warc, "http": fields(http.decode("latin-1").split("\r\n")[1:]), "payload": payload}


class Ranges:
    """Byte ranges of a file of any store that pyarrow can open."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        got = self.file.read_at(n, at)
        if len(got) != n:
            raise ValueError(f"the file ends inside the {n} bytes at {at}")
        return got

    def close(self) -> None:
        self.file.close()


def directory(ranges) -> dict[str, tuple[int, int, int]]:
    """``name -> (local header offset, stored size, compression method)`` of every member.

    ``ranges`` has ``size`` and ``read(at, n)``. Raises ValueError where the file is no ZIP file.
    """
    tail = min(ranges.size, 65_557)
    end = ranges.read(ranges.size - tail, tail)
    at = end.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(end) or at + 22 + struct.unpack_from("<H", end, at + 20)[0] > len(end)):
        at = end.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", end, at + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        place = ranges.size - tail + at - 20
        locator = ranges.read(place, 20) if place >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            big = ranges.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points to no ZIP64 record")
            count, size, start = struct.unpack_from("<QQQ", big, 32)
    raw = ranges.read(start, size)
    out, at = {}, 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        stored, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        offset = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # the saturated ones of full size, stored size and offset, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        out[name] = (offset, stored, method)
        at += 46 + n_name + n_extra + n_note
    return out


def stored_member(ranges, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Start and length of a stored member's bytes."""
    offset, size, method = entry
    if method != 0:
        raise ValueError("the member is compressed; range reads need stored members")
    head = ranges.read(offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header at the member's offset")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra, size


class PackageWriter:
    """Streams one package; the index is gathered meanwhile (a line a record)."""

    def __init__(self, stream: io.RawIOBase):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, raw: bytes, **fields) -> None:
        self.data.write(raw)
        self.lines.append(json.dumps({"offset": self.size, "length": len(raw), **fields}))
        self.size += len(raw)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()


def _shared_uri(spark: SparkSession, label: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _name(page) -> str:
    return "urn:x-page:" + ("" if page is None else str(page))


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every row; the table of packages: ``uri, records, bytes``."""
    from pyarrow import fs  # noqa: F401  fails here, not in a task

    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), whole(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    known = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    known = materialize(known.filter("n > 1 and last is not null"), "digests")
    rows = join_lookup(rows, known, "digest", "n", pages.count())
    folder = _shared_uri(spark, "archives")

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        package, out, name, done = None, None, "", []

        def finish():
            package.close()
            out.close()
            done.append((f"{folder}/{name}", len(package.lines), package.size))

        for batch in batches:
            for page, url, payload, last in zip(*(batch.column(c) for c in ("id", "url", "payload", "last"))):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{path}/{name}")
                    package = PackageWriter(_Unseekable(out))
                page, last, body = page.as_py(), last.as_py(), payload.as_py().encode()
                revisit = last is not None and page != last
                raw = record("revisit" if revisit else "response", _name(page), url.as_py(), b"" if revisit else body, digest=payload_digest(body), size=len(body), refers_to=_name(last) if revisit else None)
                package.add(raw, id=_name(page), type="revisit" if revisit else "response")
                if package.size >= package_bytes:
                    finish()
                    package = None
        if package is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["uri", "records", "bytes"])

    return materialize(rows.select("id", "url", "payload", "last").mapInArrow(run, "uri string, records long, bytes long"), "packages")


class _Unseekable(io.RawIOBase):
    """A plain sink, so that the ZIP writer streams."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def splits(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of whole records: ``uri, start, lengths``, from each package's own directory."""
    ship(packages.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple[str, int, list[int]]] = []
            for uri in batch.column("uri").to_pylist():
                ranges = Ranges(uri)
                members = directory(ranges)
                data, _ = stored_member(ranges, members[DATA])
                for line in ranges.read(*stored_member(ranges, members[INDEX])).decode().splitlines():
                    entry = json.loads(line)
                    if not rows or rows[-1][0] != uri or sum(rows[-1][2]) >= range_bytes:
                        rows.append((uri, data + entry["offset"], []))
                    rows[-1][2].append(entry["length"])
                ranges.close()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["uri", "start", "lengths"])

    return packages.select("uri").mapInArrow(run, "uri string, start long, lengths array<long>")


def read_archives(packages: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Every record of the packages: ``record_id, target_uri, record_type, refers_to, payload_bytes,
    payload_digest`` (and ``payload`` where asked for). Digests of responses are computed from what
    was read and must equal the record's own; those of revisits come from their headers."""
    spark = packages.sparkSession

    def run(batches):
        for batch in batches:
            for uri, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "lengths"))):
                ranges = Ranges(uri)
                raw, at, rows = ranges.read(start, sum(lengths)), 0, []
                ranges.close()
                for n in lengths:
                    got = parse_record(raw[at : at + n])
                    at += n
                    warc, body = got["warc"], got["payload"]
                    digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(got["http"]["content-length"])
                    if warc["warc-type"] == "response" and (size != len(body) or digest != payload_digest(body)):
                        raise ValueError(f"{uri}: the payload of {warc['warc-record-id']} is not what was written")
                    refers = warc.get("warc-refers-to")
                    rows.append((warc["warc-record-id"].strip("<>"), warc.get("warc-target-uri"), warc["warc-type"], refers.strip("<>") if refers else None, size, digest, body))
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))]
                names = ["record_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
                yield pa.RecordBatch.from_arrays(cols[: 6 + payloads], names[: 6 + payloads])

    return splits(packages).repartition(shuffle_partitions(spark)).mapInArrow(run, _RECORD_SCHEMA + ", payload binary" * payloads)


def page_records(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` and read them back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``; ids as long."""
    found = read_archives(write_archives(pages, **options))
    page = lambda c: F.expr(f"try_cast(substring({c}, length('urn:x-page:') + 1) as bigint)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
