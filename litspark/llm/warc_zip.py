"""WARC records in ZIP packages: written by tasks, and read back by ranges without extraction.

A package holds its members stored: ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj`` (a JSON line a record, with its offset and length). The reader fetches the end
of a package, parses the end record or the ZIP64 one, then the central directory, finds the data
behind each member's local header, and plans blocks of neighbouring records from the index. Blocks are dealt over
the cluster; each is one range read. An archive without index, or one that is not stored but deflated, is read as
a stream by one task, a record at a time. Archives may be plain or gzip; members packed otherwise are refused.

Packages go to a shared folder through pyarrow's file systems. A retried task writes new names; only
names in the stored table of packages, committed by Spark, count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import re
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.components import SMALL_ROWS
from litspark.llm.words import slices
from litspark.session import shared_dir
from litspark.sources.staging import stage

PACKAGE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
#: Bytes that a stream is read and unpacked by.
PIECE = 1 << 20
#: A hot payload has more pages than this, and more than one page in HOT_SHARE: fewer than HOT_SHARE payloads are.
HOT_PAGES, HOT_SHARE = 1_000, 100_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PACKAGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])
MEMBERS = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("method", T.IntegerType()),
                        T.StructField("offset", T.LongType()), T.StructField("n_bytes", T.LongType())])
BLOCKS = T.StructType([T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("n_bytes", T.LongType()),
                       T.StructField("deflated", T.BooleanType())])
RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def digest32(payload: bytes) -> str:
    """The upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(key: str | None) -> str:
    return "<urn:none:>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def key_of(name: str | None) -> str | None:
    return unquote(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, with the payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(key)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


#: Characters that a URL keeps in a header line: all printable ASCII but the blank.
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def headers(head: bytes) -> dict[str, str]:
    """The named fields behind the first line: names in lower case, folded lines joined, blanks around values gone; the first of a name counts."""
    out: dict = {}
    for line in re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")))[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _head(raw) -> tuple[dict[str, str], int]:
    """The fields of a record and where its block begins."""
    end = _HEAD_END.search(raw)
    if not raw.startswith(b"WARC/") or end is None:
        raise ValueError("no WARC record where one should begin")
    fields = headers(bytes(raw[: end.start()]))
    if lacking := [x for x in ("warc-type", "warc-record-id", "content-length") if x not in fields]:
        raise ValueError(f"a WARC record without {', '.join(lacking)}")
    return fields, end.end()


def parse_record(raw: bytes) -> dict:
    """The fields of one record. Payloads are what follows HTTP headers, or the whole block of other records.

    A revisit has the payload's length by its HTTP headers, null where they don't tell it.
    """
    fields, at = _head(raw)
    block, told = raw[at : at + int(fields["content-length"])], {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        end = _HEAD_END.search(block)
        told = headers(block[: end.start()] if end else block)
        payload = block[end.end() :] if end else b""
    else:
        payload = block
    full, size = fields["warc-type"] != "revisit", told.get("content-length", "")
    return {
        "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"),
        "payload_digest": digest32(payload) if full else fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "payload_bytes": len(payload) if full else int(size) if size.isdecimal() else None, "refers_to": fields.get("warc-refers-to"),
        "payload": payload if full else None,
    }


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Package:
    def __init__(self, folder: str):
        self.folder, self.parts, self.lines, self.size = folder, [], [], 0

    def add(self, key, url, payload: bytes, digest: str, refers_to) -> None:
        data = _gzip(record(key, url, payload, digest, refers_to))
        self.lines.append(json.dumps({"url": url, "offset": self.size, "length": len(data), "digest": f"sha1:{digest}", "filename": ARCHIVE}))
        self.parts.append(data)
        self.size += len(data)

    def write(self) -> tuple[str, int, int]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(ARCHIVE, b"".join(self.parts))
            z.writestr(INDEX, "\n".join(self.lines))
        files, folder = pafs.FileSystem.from_uri(self.folder)
        files.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        with files.open_output_stream(f"{folder}/{name}") as f:
            f.write(out.getbuffer())
        return f"{self.folder}/{name}", len(self.lines), out.tell()


def _writer(folder: str, package_bytes: int):
    def run(batches):
        package = _Package(folder)
        for part in slices(batches, "payload"):
            done = []
            for row in zip(*(part.column(c).to_pylist() for c in ("key", "url", "payload", "sha1", "first")), strict=True):
                key, url, payload, sha1, first = row
                package.add(key, url, payload, base64.b32encode(sha1).decode(), first)
                if package.size >= package_bytes:
                    done.append(package.write())
                    package = _Package(folder)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=PACKAGES.names)
        if package.lines:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in package.write()], names=PACKAGES.names)

    return run


def write_packages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_revisit: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each page; returns the packages (path, n_records, n_bytes).

    Of pages with equal payloads of ``least_revisit`` bytes or more, that with the smallest id is a response
    and the others revisit it. A null payload counts as empty. Pages without id, and rows that repeat the
    smallest id, are responses. Other columns are not read; an empty table gives no package.
    """
    spark = pages.sparkSession
    folder = folder or f"{_uri(shared_dir(spark))}/litspark/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    read = read.withColumn("sha1", F.unhex(F.sha1("payload")))
    alike = read.where(F.col("id").isNotNull() & (F.octet_length("payload") >= least_revisit))
    firsts = alike.groupBy(F.base64("sha1").alias("same")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = stage(firsts.where("first != last").select("same", "first", "n"))
    rows = _with_firsts(read.withColumn("same", F.when(F.octet_length("payload") >= least_revisit, F.base64("sha1"))), firsts)
    rows = rows.select(F.col("id").cast("string").alias("key"), "url", "payload", "sha1", F.when(F.col("id") != F.col("first"), F.col("first").cast("string")).alias("first"))
    return stage(rows.mapInArrow(_writer(folder, package_bytes), PACKAGES))


def _with_firsts(rows: DataFrame, firsts: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Rows with ``first`` of their ``same``.

    Beyond ``limit`` groups whole rows have to meet their group; then hot groups are broadcast and rows
    without ``same`` stay where they are, so neither becomes one task.
    """
    groups, total = firsts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if groups <= limit:
        return rows.join(F.broadcast(firsts.drop("n")), "same", "left")
    is_hot = F.col("n") > max(HOT_PAGES, total // HOT_SHARE)
    hot, others = F.broadcast(firsts.where(is_hot).drop("n")), firsts.where(~is_hot).drop("n")
    known = rows.where(F.col("same").isNotNull())
    cold = known.join(hot.select("same"), "same", "left_anti").join(others, "same", "left")
    none = rows.where(F.col("same").isNull()).withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    return known.join(hot, "same").unionByName(cold).unionByName(none)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _normal(path: str) -> str:
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


class Ranges:
    """Reads byte ranges of one file."""

    def __init__(self, path: str):
        files, name = pafs.FileSystem.from_uri(_normal(path))
        self.file = files.open_input_file(name)
        self.size = self.file.size()

    def read(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def close(self) -> None:
        self.file.close()


def central_directory(source) -> list[dict]:
    """The members of a ZIP file, by its central directory or ZIP64 one; ``source`` has size and read()."""
    tail_at = max(0, source.size - (1 << 16) - 22 - 20)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    n, size, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        wide = source.read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator points")
        n, size, offset = struct.unpack("<QQQ", wide[32:56])
    directory, out, at = source.read(offset, size), [], 0
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        packed, plain, named, extra, comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (header,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + named]
        more, k = directory[at + 46 + named : at + 46 + named + extra], 0
        while k + 4 <= len(more):
            kind, length = struct.unpack("<HH", more[k : k + 4])
            if kind == 1:  # wide values stand for those that are full, in this order
                wide, w = more[k + 4 : k + 4 + length], 0
                for what in ("plain", "packed", "header"):
                    value = {"plain": plain, "packed": packed, "header": header}[what]
                    if value == 0xFFFFFFFF:
                        (value,) = struct.unpack("<Q", wide[w : w + 8])
                        w += 8
                        plain, packed, header = (value if what == x else y for x, y in (("plain", plain), ("packed", packed), ("header", header)))
            k += 4 + length
        out.append({"name": name.decode("utf-8" if flags & 0x800 else "cp437"), "method": method, "encrypted": bool(flags & 1), "header": header, "packed": packed, "plain": plain})
        at += 46 + named + extra + comment
    return out


def data_offset(source, member: dict) -> int:
    """Where a member's bytes begin, behind its local header."""
    head = source.read(member["header"], 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory points")
    named, extra = struct.unpack("<HH", head[26:30])
    return member["header"] + 30 + named + extra


def _members(source) -> list[dict]:
    """The archives and indexes of a package; those that can't be read are refused."""
    found = [m for m in central_directory(source) if m["name"].startswith(("archive/", "indexes/")) and not m["name"].endswith("/")]
    for m in found:
        if m["encrypted"] or m["method"] not in (0, 8):
            raise ValueError(f"member {m['name']} is {'encrypted' if m['encrypted'] else 'packed by method %d' % m['method']}")
    return found


def _index_lines(source, member: dict):
    """The JSON parts of an index's lines; plain and gzip indexes, stored or deflated."""
    raw = pieces(source, data_offset(source, member), member["packed"], member["method"] == 8)
    rest = b""
    for piece in raw:
        *lines, rest = (rest + piece).split(b"\n")
        yield from (json.loads(x[x.index(b"{") :]) for x in lines if b"{" in x)
    if b"{" in rest:
        yield json.loads(rest[rest.index(b"{") :])


def blocks_of(source, block_bytes: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Ranges of a package's stored archives that hold whole records.

    An index names archives by their path, or by the name within ``archive/``. An archive with an entry
    that lacks offset or length counts as not indexed and is one range.
    """
    members = _members(source)
    starts = {m["name"]: (data_offset(source, m), m["packed"]) for m in members if m["method"] == 0}
    by_archive: dict = {}
    for m in members:
        if m["name"].startswith("indexes/") and m["name"].endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            for entry in _index_lines(source, m):
                name = entry.get("filename", "")
                name = name if name in starts else f"archive/{name}"
                if name in starts:
                    by_archive.setdefault(name, set()).add((int(entry.get("offset", -1)), int(entry.get("length", -1))))
    spans = []
    for name, (start, size) in starts.items():
        entries = by_archive.get(name, {(-1, -1)})
        if all(at >= 0 and n > 0 for at, n in entries):
            spans += [(start + at, n) for at, n in entries]
        elif name.startswith("archive/") and size:
            spans.append((start, size))
    out: list = []
    for at, n in sorted(spans):
        if out and out[-1][0] + out[-1][1] == at and out[-1][1] + n <= block_bytes:
            out[-1][1] += n
        else:
            out.append([at, n])
    return [tuple(x) for x in out]


def deflated_archives(source) -> list[tuple[int, int]]:
    """The ranges of archives that are not stored but deflated."""
    return [(data_offset(source, m), m["packed"]) for m in _members(source) if m["name"].startswith("archive/") and m["method"] == 8]


def _unpacked(packed, window: int):
    """What a deflate stream (window -15), or gzip members one after another (31), unpack to, in bounded pieces."""
    unpack, begun = zlib.decompressobj(window), False
    for left in packed:
        while left and not (unpack.eof and window < 0):
            if unpack.eof:
                unpack, begun = zlib.decompressobj(window), False
            piece, begun = unpack.decompress(left, PIECE), True
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if piece:
                yield piece
    if begun and not unpack.eof:
        yield unpack.flush()
        if not unpack.eof:
            raise ValueError("a packed archive is cut short")


def _plain(packed):
    """The same pieces, unpacked where they begin as a gzip member does."""
    packed, first = iter(packed), b""
    while len(first) < 2 and (piece := next(packed, None)) is not None:
        first += piece
    whole = itertools.chain([first], packed)
    return _unpacked(whole, 31) if first[:2] == b"\x1f\x8b" else whole


def pieces(source, at: int, n: int, deflated: bool = False):
    """A range's bytes, unpacked, in bounded pieces."""
    read = (source.read(k, min(PIECE, at + n - k)) for k in range(at, at + n, PIECE))
    return _plain(_unpacked(read, -15) if deflated else read)


def _records(plain):
    """The records of a stream of plain pieces; one record is held at a time."""
    held, plain = bytearray(), iter(plain)

    def fill(n: int) -> bool:
        while len(held) < n:
            if (piece := next(plain, None)) is None:
                return False
            held.extend(piece)
        return True

    while True:
        while fill(1) and held[0] in b"\r\n":
            del held[0]
        if not held:
            return
        seen = 0
        while _HEAD_END.search(held, seen) is None:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a WARC record is cut short")
        fields, at = _head(held)
        end = at + int(fields["content-length"])
        if not fill(end):
            raise ValueError("a WARC record is cut short")
        yield bytes(held[:end])
        del held[:end]


def split_records(data: bytes):
    """The records of a run of gzip members, or of plain records."""
    return _records(_plain([data]))


def _plan(block_bytes: int):
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source = Ranges(path)
                found = [(*x, False) for x in blocks_of(source, block_bytes)] + [(*x, True) for x in deflated_archives(source)]
                source.close()
                if found:
                    at, n, deflated = zip(*found, strict=True)
                    columns = [pa.array([path] * len(found)), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(deflated)]
                    yield pa.RecordBatch.from_arrays(columns, names=BLOCKS.names)

    return run


def _read(batches):
    schema = pa.schema([(n, pa.string()) for n in RECORDS.names[:4]] + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        sources: dict = {}
        for path, at, n, deflated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path not in sources:
                for old in sources.values():
                    old.close()
                sources = {path: Ranges(path)}
            rows, size = [], 0
            for raw in _records(pieces(sources[path], at, n, deflated)):
                rows.append(parse_record(raw))
                size += len(raw)
                if size >= PIECE:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_packages(packages: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of packages (a column ``path``), with payloads; a revisit has its payload's length and digest, not its bytes."""
    spark = packages.sparkSession
    blocks = stage(packages.select("path").mapInArrow(_plan(block_bytes), BLOCKS))
    tasks = max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism + blocks.count() // 64))
    return blocks.repartition(tasks, "path", "offset").mapInArrow(_read, RECORDS)


def _key(name: str):
    return F.when(F.col(name).startswith("<urn:page:"), F.url_decode(F.expr(f"substr({name}, 11, length({name}) - 11)")))


def pages_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema["page_id"].dataType
    records = read_packages(write_packages(pages))
    return records.select(
        _key("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _key("refers_to").cast(kind).alias("refers_to")
    )
