"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Each task writes one file of gzip members, one record a member, under the shared folder, and renames it into place when it
is whole, so a repeated task only repeats its own file. Files are read through their file system's own reader in
windows; one record at a time is held in memory.

The reader checks each record: the gzip member's CRC, the version line, the length, the closing blank lines and the block
digest (hex or base32). Where a check fails it searches onward for the next gzip member (or, in plain files, the next version
line) that starts a valid record, goes on from there, and reports the bytes between as a quarantined gap.

A gzip member may hold any number of records, up to a whole archive in one stream: its inflated bytes are searched as those
of a plain file are. Of a member that breaks off or fails its CRC, the records before the damage are kept whose own digest
holds and after which another record begins; their note says so. Records of one member share its byte range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import small
from .scratch import Scratch

REVISIT_BYTES = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_STEP = 1 << 14
_WINDOW = 1 << 22
_MAX_HEAD = 1 << 16
#: A longer block doesn't fit a row; its record is quarantined with that reason.
MAX_BLOCK = 1 << 30
_WHOLE = 1 << 24
HOT = 1000


def _sha1(data: bytes) -> str:
    return "sha1:" + hashlib.sha1(data).hexdigest()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    named = {"WARC-Type": kind, **fields, "WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in named.items())
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(data: bytes) -> bytes:
    """data as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, refers_to), a row for each row of pages.

    Of the rows with equal payloads of at least REVISIT_BYTES, those with the smallest id are responses, and the others refer
    to it. Rows without an id are responses. Null and empty pages have an empty payload; repeated rows are all responses, or all
    revisits. An empty table gives no rows; other columns are not read.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    ids = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest")
    ids = ids.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.count("*").alias("n")).filter("low < high")
    shared = Scratch(pages.sparkSession, "warc-shared").write(ids.select("digest", "low", "n"), "shared")
    # payloads that over a thousandth of all rows share, fewer than HOT, are told by broadcast; their rows join nothing else
    often = [bytes(r["digest"]) for r in shared.filter(F.col("n") > pages.count() / HOT).select("digest").collect()]
    lone = F.unhex(F.hex(F.xxhash64("page_id")))  # eight bytes: no digest
    told = F.col("digest").isin(often) if often else F.lit(False)
    rows = rows.withColumn("key", F.when(told | (F.col("payload_bytes") < REVISIT_BYTES), lone).otherwise(F.col("digest")))
    rows = rows.join(shared.select(F.col("digest").alias("key"), "low"), "key", "left")
    low = F.col("low")
    if often:
        few = shared.filter(told).select("digest", F.col("low").alias("often"))
        rows, low = rows.join(F.broadcast(few), "digest", "left"), F.coalesce("low", "often")
    return rows.select("page_id", "url", "payload", "digest", "payload_bytes", F.when(low < F.col("page_id"), low).alias("refers_to"))


def write(planned: DataFrame, folder: str) -> int:
    """Write the planned records into folder, a URI that all executors reach; the number of files."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        attempt, n = f"{root}/_{part:06d}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(attempt) as out:
            for b in small(batches):
                for page_id, url, payload, digest, size, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    shared = {"WARC-Record-ID": _name(page_id), "WARC-Target-URI": url or "", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": "sha256:" + digest.hex(), "X-Payload-Length": str(size)}
                    if refers is None:
                        data = record("response", shared | {"Content-Type": "application/http; msgtype=response"}, _HTTP + payload.encode("utf-8", "surrogatepass"))
                    else:
                        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                        data = record("revisit", shared | {"WARC-Profile": profile, "WARC-Refers-To": _name(refers)}, b"")
                    out.write(member(data))
                    n += 1
        if n:
            system.move(attempt, f"{root}/part-{part:06d}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64())], names=["n"])
        else:
            system.delete_file(attempt)

    return sum(1 for _ in planned.mapInArrow(run, "n long").collect())


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


class _Source:
    """Random access to a file through a window."""

    def __init__(self, f, size: int):
        self.f, self.size, self.start, self.held = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.f.seek(at)
            self.start, self.held = at, self.f.read(max(n, _WINDOW))
        return self.held[at - self.start : at - self.start + n]

    def forget(self, before: int) -> None:
        pass


class _Bytes:
    """Bytes at hand, read like a source."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def get(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def forget(self, before: int) -> None:
        pass


class _Member:
    """The inflated bytes of the gzip member at a place of a source, read forwards; error: why they end early."""

    def __init__(self, source: _Source, at: int):
        self.source, self.where, self.unpack = source, at, zlib.decompressobj(31)
        self.start, self.held, self.error, self.size = 0, bytearray(), "", 1 << 62

    def get(self, at: int, n: int) -> bytes:
        while not self.error and not self.unpack.eof and self.start + len(self.held) < at + n:
            before = self.unpack.copy() if self.held else None
            piece = self.unpack.unconsumed_tail or self.source.get(self.where, _STEP)
            if not self.unpack.unconsumed_tail:
                self.where += len(piece)
            self._inflate(piece, before)
        if self.error or self.unpack.eof:
            self.size = self.start + len(self.held)
        return bytes(self.held[at - self.start : at - self.start + n])

    def forget(self, before: int) -> None:
        """What lies before a place isn't asked for again."""
        if before - self.start > _WINDOW:
            del self.held[: before - self.start]
            self.start += before - self.start

    def _inflate(self, piece: bytes, before) -> None:
        """Add what a piece inflates to; before: the state to go back to, none at the member's start."""
        if not piece:
            self.error = "the gzip member is cut short"
            return
        try:
            self.held += self.unpack.decompress(piece, 1 << 18)
        except zlib.error as e:
            self.error, before = f"gzip: {e}", before or zlib.decompressobj(31)
            try:  # what lies before the damage
                for k in range(len(piece)):
                    self.held += before.decompress(piece[k : k + 1])
            except zlib.error:
                return

    @property
    def end(self) -> int:
        """Where the member ends in the source, once it is read to its end."""
        return self.where - len(self.unpack.unused_data)


_NO_VERSION = "no WARC version line"


class Damaged(ValueError):
    """A failed check."""


def _parse(data: bytes) -> tuple[dict[str, str], int, int]:
    """Fields, place of the block and total length of the record whose head starts data."""
    line = _VERSION.match(data)
    end = data.find(b"\r\n\r\n")
    if not line or end < 0:
        raise Damaged(_NO_VERSION if not line else "the header does not end")
    fields = {}
    for row in data[line.end() : end].split(b"\r\n"):
        k, _, v = row.partition(b":")
        fields[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        raise Damaged("no content length")
    return fields, end + 4, end + 8 + int(length)


def digest_holds(said: str, block: bytes) -> bool | None:
    """Whether a digest field (algorithm:hex or base32) is that of block; None where it can't be told."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    made, value = hashlib.new(name, block).digest(), value.strip().rstrip("=")
    if len(value) == 2 * len(made):
        return value.lower() == made.hex()
    packed = base64.b32encode(made).decode().rstrip("=")
    return value.upper() == packed if len(value) == len(packed) else None


def _record(source, at: int):
    """(fields, block, end, verified) of the record at a place; verified: its own digest holds."""
    head = source.get(at, 4096)
    if b"\r\n\r\n" not in head and _VERSION.match(head):
        head = source.get(at, _MAX_HEAD)
    fields, body, stop = _parse(head)
    if stop - body > MAX_BLOCK:
        raise Damaged("the record is larger than a row may be")
    if at + stop > source.size:
        raise Damaged("the record is cut short or overlong")
    block = source.get(at + body, stop - body)
    if len(block) != stop - body or block[-4:] != b"\r\n\r\n":
        raise Damaged("the record is cut short or overlong")
    block = block[:-4]
    verified = digest_holds(fields.get("warc-block-digest", ""), block)
    if verified is False:
        raise Damaged("the block digest differs")
    return fields, block, at + stop, verified is True


def _records(source) -> Iterator[tuple]:
    """("record", start, end, fields, block, verified) and ("gap", start, end, reason, None, False) of bytes that aren't packed."""
    at, gap, reason = 0, -1, ""
    while source.get(at, 1):
        source.forget(at)
        try:
            fields, block, end, verified = _record(source, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            at = _next(source, at + 1, False)
            continue
        if gap >= 0:
            yield "gap", gap, at, reason, None, False
            gap = -1
        yield "record", at, end, fields, block, verified
        at = end
    if gap >= 0:
        yield "gap", gap, at, reason, None, False


def _member_records(source: _Source, at: int) -> tuple[Iterator[tuple], int, str]:
    """The records and gaps of the gzip member at a place, where it ends, and why it breaks off (empty: it doesn't)."""
    if source.get(at, 3) != _MAGIC:
        return iter(()), at, "no gzip member"
    member_ = _Member(source, at)
    member_.get(0, _WHOLE)
    if member_.unpack.eof or member_.error:
        return _records(_Bytes(bytes(member_.held))), member_.end, member_.error
    place = _WHOLE  # too long to hold: once to see whether it is whole, then again for the records
    while len(member_.get(place, _WINDOW)) == _WINDOW:
        place += _WINDOW
        member_.forget(place)
    return _records(_Member(source, at)), member_.end, member_.error


def _next(source, at: int, packed: bool) -> int:
    """The next place from at on that may start a record; the end where there is none."""
    while piece := source.get(at, _WINDOW):
        if packed:
            found = piece.find(_MAGIC)
        else:
            m = _VERSION.search(piece)
            found = m.start() if m else -1
        if found >= 0:
            return at + found
        if len(piece) < _WINDOW:
            return at + len(piece)
        at += len(piece) - 16
        source.forget(at)
    return min(at, source.size)


def _kept(found: Iterator[tuple]) -> Iterator[tuple]:
    """Of a damaged member: the records whose digest holds and after which the version line of another follows."""
    before = None
    for kind, start, stop, what, block, verified in found:
        if before and before[2] == start and (kind == "record" or what != _NO_VERSION):
            yield before
        before = (kind, start, stop, what, block) if kind == "record" and verified else None


def salvage(f, size: int) -> Iterator[tuple]:
    """("record", start, end, fields, block) and ("gap", start, end, reason, None), in order, covering the file.

    In gzip files the places are those of members; a gap within a member names its inflated bytes in the reason.
    """
    source = _Source(f, size)
    if source.get(0, 3) != _MAGIC and (_VERSION.match(source.get(0, 16)) or _next(source, 0, False) <= _next(source, 0, True)):
        for kind, start, end, what, block, _ in _records(source):
            yield kind, start, end, what, block
        return
    at, gap, reason = 0, -1, ""
    while at < size:
        found, end, error = _member_records(source, at)
        if error:
            end = _next(source, at + 1, True)
        some, first = False, ""
        for kind, start, stop, what, block in _kept(found) if error else (r[:5] for r in found):
            if kind == "gap":
                first = first or f"{what} (inflated bytes {start} to {stop})"
                continue
            if gap >= 0:
                yield "gap", gap, at, reason, None
                gap = -1
            if first and not error:
                yield "gap", at, end, first, None
                first = ""
            some = True
            yield "record", at, end, what | {"salvaged": error} if error else what, block
        if some and (error or first):
            yield "gap", at, end, error or first, None
        elif not some and gap < 0:
            gap, reason = at, error or first or "an empty gzip member"
        at = end
    if gap >= 0:
        yield "gap", gap, size, reason, None


SCHEMA = "file string, start long, end long, kind string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, note string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record (kind record) and each quarantined byte range (kind gap, with the reason in note) of the .warc
    and .warc.gz files in folder. payload is a record's block without the HTTP header. Empty files give no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    rows = files.collect()  # names and sizes only
    dealt = spark.createDataFrame(rows, "path string, length long").repartition(max(1, len(rows)), "path") if rows else files

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.binary() if c.endswith("binary") else pa.string() for c in SCHEMA.split(", ")]

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                held, heavy = [], 0
                with system.open_input_file(name) as f:
                    for kind, start, end, what, block in salvage(f, size):
                        if kind == "gap":
                            held.append((path, start, end, kind, None, None, None, None, None, None, None, what))
                        else:
                            payload = block.partition(b"\r\n\r\n")[2] if what.get("content-type", "").startswith("application/http") else block
                            length = what.get("x-payload-length", "")
                            held.append((path, start, end, kind, what.get("warc-type"), what.get("warc-record-id"), what.get("warc-target-uri"), what.get("warc-refers-to"), what.get("warc-payload-digest"), int(length) if re.fullmatch("[0-9]{1,18}", length) else None, payload, what.get("salvaged")))
                            heavy += len(payload)
                        if len(held) >= 2000 or heavy > 1 << 24:
                            yield batch(held)
                            held, heavy = [], 0
                if held:
                    yield batch(held)

    return dealt.mapInArrow(run, SCHEMA)
