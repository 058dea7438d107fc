"""WARC archives: a writer with revisit records, and a reader that salvages what damaged archives still hold.

The reader checks every record (gzip CRC, version line, header block, Content-Length, terminator, payload digest).
After a failed check it looks for the next gzip member or version line that passes, goes on from there and logs the
bytes between as a quarantined gap. Inside a member it looks in the inflated bytes; of a damaged member it keeps the
records before the damage whose payload digest is right.

Archives are opened through pyarrow.fs, so the folder may be any URI that it and Spark both know (file, hdfs, s3, gs).
Writers list finished files in a manifest; a file left by a lost task is in no manifest and is never read.

Defined results: a null html is an empty payload; a null page_id is kept as null; pages repeated under the smallest id
of their payload are all responses; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import shared_dir, written

MIN_PAYLOAD = 100
ROLL_BYTES = 32 << 20
_CHUNK = 1 << 20
_GZIP = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "path string, start long, end long, gap boolean, reason string, page_id long, record_type string, refers_to long, "
    "uri string, payload_bytes long, payload_digest string"
)


def with_types(pages: DataFrame, least: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload, digest, n, refers_to: the first holder of each large enough payload is the response."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    first = (
        rows.where(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("times"))
        .where("times > 1")
        .drop("times")
    )
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", "n",
        F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with its terminator. A revisit holds the HTTP headers alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-no-url")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(path: str):
    from pyarrow import fs

    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    where, name = fs.FileSystem.from_uri(uri)
    return where, name


def write_archives(rows: DataFrame, folder: str, compress: bool = True, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the rows of with_types as archives below folder; the manifest: path, bytes, records."""

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, size, n, made = None, "", 0, 0, []
        for frame in frames:
            for x in zip(*(frame[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                page, refers = (None if pd.isna(v) else int(v) for v in (x[0], x[4]))
                data = record(page, x[1], x[2], x[3], refers)
                data = _member(data) if compress else data
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
                    where, name = _open(path)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    out, size, n = where.open_output_stream(name, compression=None), 0, 0
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    out.close()
                    made.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            made.append((path, size, n))
        yield pd.DataFrame(made, columns=["path", "bytes", "records"])

    return written(rows.mapInPandas(save, "path string, bytes long, records long"), "warc-manifest")


class _Bytes:
    """A window over an open file, read in chunks as far as asked for."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.buf = 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.buf)):
            self.at = start
            self.buf = self.file.read_at(max(n, min(_CHUNK, self.size - start)), start)
        return self.buf[start - self.at : start - self.at + n]

    def find(self, start: int) -> int:
        """The next place at or after start where a member or a record may begin; the end if there is none."""
        while start < self.size:
            part = self.get(start, _CHUNK)
            hits = [k for k in (part.find(_GZIP), part.find(_VERSION)) if k >= 0]
            if hits:
                return start + min(hits)
            if start + len(part) >= self.size:
                break
            start += max(1, len(part) - 8)
        return self.size


class Damaged(ValueError):
    pass


def _head(raw: bytes, once: bool = False) -> dict[str, str]:
    """The fields of a header block; once: a field that repeats shows that two blocks ran together."""
    got = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        name = name.decode("latin-1").strip().lower()
        if once and name in got and name != "warc-concurrent-to":
            raise Damaged("header field repeats")
        got[name] = value.decode("utf-8", "replace").strip()
    return got


def _parse(get, start: int, size: int) -> tuple[dict, int]:
    """The record at start and where it ends; get(start, n) reads bytes of a source of this size."""
    if get(start, len(_VERSION)) != _VERSION:
        raise Damaged("no version line")
    n = 4096
    while (k := (head := get(start, n)).find(_END)) < 0:
        if len(head) < n or n > 1 << 20:
            raise Damaged("header block has no end")
        n *= 4
    head = _head(head[:k], once=True)
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no Content-Length")
    body_at, body_n = start + k + 4, int(length)
    if body_at + body_n + 4 > size:
        raise Damaged("truncated")
    body = get(body_at, body_n)
    if get(body_at + body_n, 4) != _END:
        raise Damaged("no terminator after the block")
    return _content(head, body), body_at + body_n + 4


def _id(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def _content(head: dict[str, str], body: bytes) -> dict:
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").rpartition(":")[2]
    got = {"record_type": kind, "page_id": _id(head.get("warc-record-id")), "uri": head.get("warc-target-uri"),
           "refers_to": None, "payload_bytes": len(body), "payload_digest": digest, "checked": False}
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = body.partition(_END)
        if kind == "revisit":
            said = _head(http).get("content-length", "")
            got |= {"refers_to": _id(head.get("warc-refers-to")), "payload_bytes": int(said) if said.isdigit() else None}
        else:
            own = hashlib.sha256(payload).hexdigest()
            if digest and digest != own:
                raise Damaged("payload digest differs")
            got |= {"payload_bytes": len(payload), "payload_digest": own, "checked": bool(digest)}
    return got


def _inflate(src: _Bytes, start: int) -> tuple[bytes, int, str]:
    """What a member holds, where it ends, and why it ends early (empty if it does not)."""
    z, at, out = zlib.decompressobj(31), start, []
    while not z.eof:
        part = src.get(at, 1 << 16)
        if not part:
            return b"".join(out), at, "member is cut off"
        before = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            for k in range(len(part)):  # up to the byte that fails
                try:
                    out.append(before.decompress(part[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), at + k, f"bad member: {e}"
        at += len(part)
    return b"".join(out), at - len(z.unused_data), ""


def _packed_until(src: _Bytes, start: int, n: int) -> int:
    """A place in a member whose bytes before it inflate to less than n bytes, by at most 64 bytes of the member."""
    z, at, size = zlib.decompressobj(31), start, 0
    while True:
        part = src.get(at, 64)
        try:
            size += len(z.decompress(part))
        except zlib.error:
            return at
        if size >= n or not part:
            return at
        at += 64


def _inside(data: bytes, damage: str) -> tuple[list[dict], int]:
    """Records and gaps of an inflated member, in order, and where its last good record ends.

    In a damaged member only records whose payload digest is right are good.
    """
    rows, k, good, bad = [], 0, 0, None
    while k < len(data):
        try:
            got, end = _parse(lambda s, n: data[s : s + n], k, len(data))
            if damage and not got["checked"]:
                raise Damaged(damage)
        except Damaged as e:
            bad = bad or (k, str(e))
            k = data.find(_VERSION, k + 1)
            k = len(data) if k < 0 else k
            continue
        if bad:
            rows.append({"gap": True, "reason": f"{bad[1]} (inflated bytes {bad[0]} to {k})"})
            bad = None
        rows.append(got | {"gap": False})
        k = good = end
    if bad or damage:
        a, why = bad or (k, damage)
        rows.append({"gap": True, "reason": f"{damage or why} (inflated bytes from {a})"})
    if not good and rows:
        raise Damaged(damage or bad[1])
    return rows, good


def salvage(file) -> Iterator[dict]:
    """Records and gaps of one open archive, in order, covering each of its bytes once; those of one member share its bytes."""
    src = _Bytes(file)
    at = 0
    bad_from, reason = None, ""
    while at < src.size:
        try:
            if src.get(at, 3) == _GZIP:
                data, end, damage = _inflate(src, at)
                if damage and not data:
                    raise Damaged(damage)
                found, good = _inside(data, damage)
                if damage:  # another member may begin anywhere after the last good record
                    end = src.find(max(at + 1, _packed_until(src, at, good)))
            else:
                got, end = _parse(src.get, at, src.size)
                found = [got | {"gap": False}]
        except Damaged as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            at = src.find(at + 1)
            continue
        if bad_from is not None:
            yield {"start": bad_from, "end": at, "gap": True, "reason": reason}
            bad_from = None
        for got in found:
            yield got | {"start": at, "end": end}
        at = end
    if bad_from is not None:
        yield {"start": bad_from, "end": src.size, "gap": True, "reason": reason}


def read_archives(paths: DataFrame) -> DataFrame:
    """All records and quarantined gaps of the archives listed in column path, a task's files one after another."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                where, name = _open(path)
                with where.open_input_file(name) as f:
                    rows = []
                    for x in salvage(f):
                        rows.append([path, *(x.get(n) for n in names[1:])])
                        if len(rows) >= 5000:
                            yield _frame(rows, names)
                            rows = []
                    if rows:
                        yield _frame(rows, names)

    return paths.select("path").mapInPandas(load, RECORD)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives below a folder, by Spark's own file listing; contents stay unread here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder).select("path")


def round_trip(pages: DataFrame, compress: bool = True) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = write_archives(with_types(pages), folder if "://" in folder else f"file://{folder}", compress)
    n = max(1, made.count())
    return read_archives(made.repartition(min(n, 4096), F.col("path")))


SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND m < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND m < page_id THEN m END AS refers_to
FROM f
"""


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return (
        round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
        .where("not gap")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
