"""WARC records in ZIP packages: written with revisit records, read back by ranges without extraction.

A package is a ZIP file of stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.jsonl``, a line with offset and length for each. The reader finds the end-of-directory record, its ZIP64
form where there is one, then the central directory, the stored members and the index, and reads just the
byte ranges of the records it wants.

Equal payloads are found on narrow rows (digest and id). Packages are bounded in size; a run of a package's index
is one reading task, and reads those lines alone. Packages of other tools may hold several archives and indexes in
lines of JSON, with or without a key before it, that name offset, length and archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import accumulate, groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import id_or_last, materialize, scratch_path, spread

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PACKAGE_BYTES = 64 << 20
#: Records one reading task takes, and bytes it reads at once.
RUN_RECORDS, RUN_BYTES = 2000, 8 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value holds no line breaks."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value or "")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = lambda i: uuid.uuid5(_SPACE, f"page:{i}").urn
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(page_id)}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url) or 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; a response's digest, if it has one, is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = _fields(lines)
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its block")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    web = _fields(http.decode("utf-8", "replace").split("\r\n")[1:])
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response" and digest.startswith("sha1:") and digest != f"sha1:{sha1_base32(payload)}":
        raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't have its digest")
    return {"fields": fields, "http": web, "payload": payload}


def _gz(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


class PackageWriter:
    """Streams records into one package; ``close`` adds the index and the directory."""

    def __init__(self, path: str) -> None:
        self.path, self.index, self.at = path, [], 0
        self.out = files.write(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, ident, raw: bytes) -> None:
        packed = _gz(raw)
        self.member.write(packed)
        self.index.append(json.dumps({"id": ident, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> list[tuple[int, int]]:
        """Where in the index each run of records lies: (offset, length)."""
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in self.index))
        self.zip.close()
        self.out.close()
        ends = [0, *accumulate(len(x) + 1 for x in self.index)]
        cuts = [*range(0, len(self.index), RUN_RECORDS), len(self.index)]
        return [(ends[a], ends[b] - ends[a]) for a, b in pairwise(cuts)]


# The directories of a ZIP file, parsed from their bytes.


def _end_of_directory(f, size: int) -> tuple[int, int, int]:
    """Entries, size and offset of the central directory, from the ZIP64 record where the short one is full."""
    tail_at = max(0, size - 65557)
    tail = files.read_range(f, tail_at, size - tail_at)
    k = tail.rfind(b"PK\5\6")
    while k >= 0:  # a comment may hold the mark: the record must reach to the end of the file
        if k + 22 <= len(tail) and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail):
            break
        k = tail.rfind(b"PK\5\6", 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, k + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = files.read_range(f, tail_at + k - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end = files.read_range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", end, 32)
    return entries, length, offset


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Where the data of each stored member lies: (offset, length) by name. Compressed members are left out."""
    entries, length, offset = _end_of_directory(f, size)
    raw, at, out = files.read_range(f, offset, length), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method, packed, plain, n, extra, comment, local = (*struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<II", raw, at + 20), *struct.unpack_from("<HHH", raw, at + 28), *struct.unpack_from("<I", raw, at + 42))
        name = raw[at + 46 : at + 46 + n].decode("utf-8")
        k, stop = at + 46 + n, at + 46 + n + extra
        while k + 4 <= stop:  # the ZIP64 field holds those values, in this order, that don't fit above
            tag, width = struct.unpack_from("<HH", raw, k)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", raw, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + width
        at = stop + comment
        if method == 0:
            head = files.read_range(f, local, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError("a broken local header")
            out[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
    return out


def read_records(path: str, span: tuple[int, int] | None = None) -> Iterator[tuple[object, bytes]]:
    """(id, record) of the records that ``span`` (offset, length) of the package's own index names, or all indexes of any package.

    A line of an index may name its archive; without that the package must have one. Neighbouring records are read as one range.
    """
    with files.read(path) as f:
        where = members(f, f.size())
        archives = {n: x for n, x in where.items() if n.startswith("archive/")}
        if span is None:
            text = b"\n".join(files.read_range(f, *x) for n, x in where.items() if n.startswith("indexes/") and not n.endswith(".gz"))
        else:
            text = files.read_range(f, where[INDEX][0] + span[0], span[1])
        lines = [json.loads(x[x.index("{") :]) for x in text.decode().split("\n") if "{" in x]
        only = next(iter(archives)) if len(archives) == 1 else None
        rows = [(r["filename"] if "filename" in r else only, int(r["offset"]), int(r["length"]), r.get("id")) for r in lines]
        for name, run in groupby(rows, lambda r: r[0]):
            base = archives[name if name in archives else f"archive/{name}"][0]
            held = list(run)
            i = 0
            while i < len(held):
                start, j = held[i][1], i + 1
                while j < len(held) and held[j][1] >= start and held[j][1] + held[j][2] - start <= RUN_BYTES:
                    j += 1
                raw = files.read_range(f, base + start, max(r[1] + r[2] for r in held[i:j]) - start)
                for _, offset, length, ident in held[i:j]:
                    packed = raw[offset - start : offset - start + length]
                    yield ident, gzip.decompress(packed) if packed[:2] == b"\x1f\x8b" else packed
                i = j


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row as a record; (path, offset, length) of the packages and the runs of their indexes.

    Of equal payloads of at least ``least`` bytes the row with the smallest id is the response. Rows that
    share that id are all responses, and so are all rows where every id is null: null ids sort last. A
    null payload is empty. A package belongs to the attempt that reports it.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files.make_dir(folder)
    payload = F.coalesce(F.encode(pages[payload_col].cast("string"), "UTF-8"), F.lit(b""))
    rows = spread(pages).select(pages[id_col].cast("long").alias("id"), id_or_last(id_col).alias("key"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = materialize(rows.where(F.length("payload") >= least).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "firsts")
    linked = rows.join(firsts, "sha", "left").select("id", "url", "payload", F.when(F.col("key") > F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = None

        def done(p):
            runs = p.close()
            offset, length = zip(*runs, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([p.path] * len(runs)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["path", "offset", "length"])

        for b in batches:
            for ident, url, body, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pack = pack or PackageWriter(f"{folder}/{uuid.uuid4().hex}.zip")
                pack.add(ident, record(ident, url, body, sha1_base32(body), "response" if first is None else "revisit", first))
                if pack.at >= package_bytes:
                    yield done(pack)
                    pack = None
        if pack:
            yield done(pack)

    return materialize(linked.mapInArrow(run, "path string, offset long, length long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record of ``packages`` (path, offset, length)."""
    spark = packages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, *span in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out = []
                for ident, raw in read_records(path, tuple(span)):
                    r = parse_record(raw)
                    f = r["fields"]
                    size = len(r["payload"]) if f["warc-type"] == "response" else int(r["http"]["content-length"])  # a revisit tells it in its header
                    out.append((ident, size, f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], int(f["x-refers-to-page"]) if f["warc-type"] == "revisit" else None, f["warc-target-uri"]))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return materialize(packages.select("path", "offset", "length").repartition(n, "path", "offset").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"), "records")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all rows and read all records back: one row per input row; repeated rows stay repeated."""
    return read_packages(write_packages(pages, id_col, url_col, payload_col, least, package_bytes)).drop("url")



def oracle() -> str:
    """The same rows from the payloads themselves; base32 is dealt from five hexadecimal digits at a time."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 5 * (j // 4) + 1, 5))::BIGINT >> (15 - 5 * (j % 4))::BIGINT) & 31), 1)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
      SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: {digit}), '') AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM p"""
