"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what it can from damaged files.

The writer marks, of records with equal payloads of ``least_bytes`` or more, the one with the largest id as response and the others as
revisits of it. Every record is a gzip member of its own. A task writes its files under names that no other attempt uses, and only
the files listed in the manifest, which Spark commits, belong to the archive; so a lost executor leaves no half-written file in it.

The reader goes through a file member by member (or record by record if it is not compressed); a member may hold many records, which are
parsed as it is decompressed. A record passes if its part of the member decompresses, its header (of any length) parses, its block has the
stated length and its digests match, in hex or base32 of any case; digests of unknown kinds are not compared. The last record of a member
needs the member's own checksum too. After a failed check it searches for
the next place where a gzip member, or a version line, begins and passes, and goes on from there; the bytes between are logged as a
quarantined gap with the reason. A task holds one record and a read buffer, not a file.

A null payload is empty. A null id is written as an empty one and read back as null; it holds no payload for others. Rows that repeat
the id of the response are responses too. Extra columns are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_work_dir

LEAST_BYTES = 1000
_FILE_BYTES = 32 << 20
_CHUNK = 1 << 18
_STEP = 1 << 14
_LINE = 512
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HEADER_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Digests that are compared; records with others pass unchecked.
_DIGESTS = ("md5", "sha1", "sha256", "sha512")
_RECORDS = (
    "path string, start long, end long, problem string, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)
_TYPES = (
    pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(),
)
_ID = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, holder: int | None) -> bytes:
    """One record in WARC 1.1; a revisit if ``holder`` is given."""
    block = b"" if holder is not None else _HTTP % len(payload) + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if holder is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if holder is not None:
        head += [f"WARC-Refers-To: <{_ID}{holder}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _HEADER_END + block + _HEADER_END


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        out, size, records = None, 0, 0
        name = ""

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, payload, digest, holder in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "holder"))):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, digest, holder)) + packer.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= _FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_pages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row below ``folder``, which all executors share; returns the manifest (``path``, ``bytes``, ``records``)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(f"`{payload_col}`").cast("string"), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    holders = own.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("held_by"))
    marked = own.join(holders, "digest", "left")
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("held_by").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("held_by")))
    rows = marked.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("held_by")).alias("holder"))
    rows.mapInArrow(_written(f"{folder}/archives"), "path string, bytes long, records long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class _File:
    """A file that is read in chunks from any place."""

    def __init__(self, store, path: str):
        self._file = store.open_input_file(path)
        self.size = self._file.size()
        self._at, self._chunk = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self._at or at + n > self._at + len(self._chunk):
            self._at = at
            self._file.seek(at)
            self._chunk = self._file.read(max(n, _CHUNK))
        return self._chunk[at - self._at : at - self._at + n]

    def some(self, at: int) -> bytes:
        """Bytes from a place on, as many as are at hand; none at the end of the file."""
        if not self._at <= at < self._at + len(self._chunk):
            self.read(at, _CHUNK)
        return self._chunk[at - self._at : at - self._at + _STEP]

    def find(self, what: re.Pattern, at: int, longest: int) -> int:
        """The first match at or after a place, or the file's size."""
        while at < self.size:
            chunk = self.read(at, _CHUNK)
            match = what.search(chunk)
            if match:
                return at + match.start()
            at += max(1, len(chunk) - longest + 1)
        return self.size


class Damage(Exception):
    """A record that fails a check."""


class _Content:
    """What a file holds from a place on, taken from the front; ``position`` is the place in the file up to which it was needed."""

    def __init__(self, file: _File, at: int):
        self._file, self._place, self._buffer = file, at, bytearray()

    def _fill(self, n: int) -> bool:
        """Takes in more, about ``n`` bytes if that can be told; false at the end."""
        chunk = self._file.some(self._place)
        self._place += len(chunk)
        self._buffer += chunk
        return bool(chunk)

    @property
    def position(self) -> int:
        return self._place - len(self._buffer)

    def holds(self, n: int) -> bool:
        return self.position + n <= self._file.size

    def more(self) -> bool:
        return bool(self._buffer) or self._fill(1)

    def take(self, n: int) -> bytes:
        if not self.holds(n):
            raise Damage("the file ends within a record")
        while len(self._buffer) < n:
            if not self._fill(n - len(self._buffer)):
                raise Damage("the file ends within a record")
        out = bytes(self._buffer[:n])
        del self._buffer[:n]
        return out

    def line(self) -> bytes:
        seen = 0
        while (end := self._buffer.find(b"\r\n", seen)) < 0:
            seen = max(0, len(self._buffer) - 1)
            if not self._fill(_LINE):
                raise Damage("a header does not end")
        return self.take(end + 2)[:-2]


class _Member(_Content):
    """The content of the gzip member at a place."""

    def __init__(self, file: _File, at: int):
        super().__init__(file, at)
        self._unpacker = zlib.decompressobj(31)

    def _fill(self, n: int) -> bool:
        size = len(self._buffer)
        while len(self._buffer) == size and not self._unpacker.eof:
            raw = self._unpacker.unconsumed_tail
            if not raw:
                raw = self._file.some(self._place)
                self._place += len(raw)
            try:
                part = self._unpacker.decompress(raw, min(n, _CHUNK))
            except zlib.error as error:
                raise Damage(f"a member does not decompress: {error}") from error
            if not raw and not part and not self._unpacker.eof:
                raise Damage("the file ends within a member")
            self._buffer += part
        return len(self._buffer) > size

    @property
    def position(self) -> int:
        return self._place - len(self._unpacker.unused_data if self._unpacker.eof else self._unpacker.unconsumed_tail)

    def holds(self, n: int) -> bool:
        return True


def _headers(content: _Content) -> dict[str, str]:
    """The header lines, however many; junk ends at its first line that is none."""
    version = content.take(10)
    if not _VERSION.match(version):
        raise Damage("no version line")
    found = {}
    while line := content.line():
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("a header line has no colon")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]+", found.get("content-length", "")) or "warc-type" not in found:
        raise Damage("no length or type in a header")
    return found


def _digest(stated: str | None) -> tuple[str, str] | None:
    """A labelled digest as algorithm and lower-case hex, from hex or base32 in any case; None if it cannot be read, which leaves it unchecked."""
    algorithm, _, value = (stated or "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in _DIGESTS:
        return None
    size = hashlib.new(algorithm).digest_size
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (algorithm, raw.hex()) if len(raw) == size else None


def _agrees(stated: str | None, content: bytes) -> bool:
    known = _digest(stated)
    return known is None or hashlib.new(known[0], content).hexdigest() == known[1]


def _number(text: str | None) -> int | None:
    digits = (text or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits.lstrip("-").isdigit() else None


def _checked(headers: dict[str, str], block: bytes) -> tuple:
    """A record's fields, after its digests were compared."""
    if not _agrees(headers.get("warc-block-digest"), block):
        raise Damage("the block does not match its digest")
    kind, stated = headers["warc-type"], headers.get("warc-payload-digest")
    known = _digest(stated)
    digest = known[1] if known and known[0] == "sha1" else None
    payload = None
    size = int(headers["x-payload-length"]) if re.fullmatch("[0-9]+", headers.get("x-payload-length", "")) else None
    if kind == "response":
        payload = block.partition(_HEADER_END)[2] if block.startswith(b"HTTP/") else block
        if not _agrees(stated, payload):
            raise Damage("the payload does not match its digest")
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return (_number(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, size, digest, _number(headers.get("warc-refers-to")), payload)


def _record(content: _Content) -> tuple:
    headers = _headers(content)
    block = content.take(int(headers["content-length"]))
    if content.take(len(_HEADER_END)) != _HEADER_END:
        raise Damage("a block does not have the stated length")
    return _checked(headers, block)


_BEGINNING = re.compile(re.escape(_MAGIC) + rb"|WARC/1\.[01]\r\n")


def _passing(file: _File, at: int) -> Iterator[tuple[int, tuple]]:
    """Where they end, and the fields, of the records of the member, or the one plain record, at a place. Ends with :class:`Damage` where a check fails."""
    start = file.read(at, 16)
    if start.startswith(_MAGIC):
        content = _Member(file, at)
        more = True
        while more:
            fields = _record(content)
            end = content.position
            more = content.more()  # at the end of a member, its own checksum is compared here
            yield end if more else content.position, fields
    elif _VERSION.match(start):
        content = _Content(file, at)
        fields = _record(content)
        yield content.position, fields
    else:
        raise Damage("neither a member nor a version line")


def records_of(file: _File) -> Iterator[tuple]:
    """(start, end, problem, fields) of every record and every gap of a file, in order.

    Records that share a member share out its bytes: each ends where the bytes read for it end.
    """
    at, gap, reason = 0, None, ""
    while at < file.size:
        try:
            for end, fields in _passing(file, at):
                if gap is not None:
                    yield gap, at, reason, None
                    gap = None
                yield at, end, None, fields
                at = end
        except Damage as damage:
            if gap is None:
                gap, reason = at, str(damage)
            at = file.find(_BEGINNING, at + 1, 10)
    if gap is not None and gap < file.size:
        yield gap, file.size, reason, None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES)], names=[c.split()[0] for c in _RECORDS.split(", ")])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = _filesystem(path)
                rows, size = [], 0
                for start, end, problem, fields in records_of(_File(store, place)):
                    fields = fields or (None,) * 7
                    if not with_payload:
                        fields = (*fields[:6], None)
                    rows.append((path, start, end, problem, *fields))
                    size += len(fields[6] or b"") + 200
                    if size >= 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return run


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the files in column ``path``. ``problem`` is null for records; for gaps it says why the bytes from ``start`` to ``end`` were set aside."""
    dealt = paths.select("path").repartition(max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(_read(with_payload), _RECORDS)


def page_digests(pages: DataFrame) -> DataFrame:
    """Write all pages and read them back: per page ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    spark: SparkSession = pages.sparkSession
    found = read_archives(write_pages(pages, new_work_dir(spark, "warc")), with_payload=False)
    return found.filter("problem is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
