"""WARC archives: writing pages with revisit records, and a salvage reader that goes on after damage."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import qualified, scratch, small_batches, stored

#: A payload of fewer bytes is never a revisit.
LEAST_REVISIT = 100
#: An archive is closed when it is this large.
ARCHIVE_BYTES = 64 << 20
READ = 1 << 18
#: Repeated payloads up to this number (64 hex digits and an id each) are given to each worker; more are joined.
FEW_REPEATED = 100_000
#: First bytes of a plain record to look for its headers in; twice as many each time that they don't end there.
HEADER = 1 << 16
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location with its scheme (see qualified)."""
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member that holds a response, or a revisit without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else " ".join(url.split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to),
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, to: str) -> DataFrame:
    """Write pages(page_id, url, html) as gzip archives into the folder `to`; (path, records, bytes) of each.

    Of pages with equal payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is the response and
    the others revisit it. Null html is an empty payload, a null url is left out, a page without id is a response and
    never revisited. Archives of attempts that were lost stay unlisted. Pages are written where they are read: only
    digests and ids are shuffled, and payloads only if more of them repeat than FEW_REPEATED.
    """
    spark = pages.sparkSession
    small_batches(spark)
    to = qualified(spark, to)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    read = read.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = read.filter((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.filter("n > 1").select("digest", "first"), "warc-repeated")
    if first.count() <= FEW_REPEATED:
        read = read.join(F.broadcast(first), "digest", "left")
    else:  # small payloads repeat most and are never revisits, so that they stay where they are
        small = F.octet_length("html") < LEAST_REVISIT
        read = read.filter(~small).join(first, "digest", "left").unionByName(read.filter(small).withColumn("first", F.lit(None).cast("long")))
    read = read.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(to)
        store.create_dir(folder, recursive=True)
        out, path, count, size = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, count, size = f"{to}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(place(path)[1], compression=None)
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stored(read.mapInArrow(work, "path string, records long, bytes long"), "warc-list")


class Salvage:
    """Records of one archive, gzip members or plain, and the gaps between them that could not be read."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _at(self, pos: int, n: int) -> bytes:
        self.file.seek(pos)
        return self.file.read(n)

    def _member(self, pos: int) -> tuple[bytes, int] | None:
        unpack, out, fed = zlib.decompressobj(31), [], pos
        while not unpack.eof:
            data = self._at(fed, READ)
            if not data:
                return None
            try:
                out.append(unpack.decompress(data))
            except zlib.error:
                return None
            if fed == pos and out[0] and not out[0].startswith(VERSION[: len(out[0])]):
                return None
            fed += len(data)
        return b"".join(out), fed - len(unpack.unused_data)

    @staticmethod
    def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
        end = data.find(b"\r\n\r\n")
        if end < 0 or not data.startswith(VERSION):
            return None
        pairs = [line.partition(b":") for line in data[:end].split(b"\r\n")[1:]]
        return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "surrogatepass").strip() for k, _, v in pairs}, end + 4

    def _plain_headers(self, pos: int) -> tuple[dict[str, str], int] | None:
        """Headers of the plain record at pos, however long; a next version line before their end ends the search."""
        data, n = self._at(pos, HEADER), HEADER
        while b"\r\n\r\n" not in data and b"\n" + VERSION not in data and len(data) == n:
            data, n = data + self._at(pos + n, n), 2 * n
        return self._headers(data.partition(b"\n" + VERSION)[0])

    def _record(self, pos: int) -> tuple[dict[str, str], bytes, int] | None:
        """Headers, block and end of the record at pos, if all of its checks hold."""
        start = self._at(pos, len(VERSION))
        try:
            if start.startswith(GZIP):
                member = self._member(pos)
                found = member and self._headers(member[0])
                if not found:
                    return None
                (head, at), (data, after) = found, member
                n = int(head.get("content-length", -1))
                block, rest = data[at : at + n], data[at + max(n, 0) :]
            elif start == VERSION:
                found = self._plain_headers(pos)
                if not found:
                    return None
                head, at = found
                n = int(head.get("content-length", -1))
                if n > self.size:
                    return None
                data = self._at(pos + at, n + 4) if n >= 0 else b""
                block, rest, after = data[: max(n, 0)], data[max(n, 0) :], pos + at + n + 4
            else:
                return None
        except (ValueError, UnicodeDecodeError):
            return None
        if n < 0 or len(block) != n or rest != b"\r\n\r\n":
            return None
        kind, _, digest = head.get("warc-block-digest", "").partition(":")
        if kind == "sha256" and digest != hashlib.sha256(block).hexdigest():
            return None
        return head, block, after

    def _next(self, pos: int) -> int:
        """The next place from pos on where a member or a version line may begin."""
        while pos < self.size:
            data = self._at(pos, READ + len(VERSION))
            found = [i for i in (data.find(GZIP), data.find(VERSION)) if i >= 0]
            if found:
                return pos + min(found)
            pos += READ
        return self.size

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None]]:
        """(start, end, headers, block) of each record; headers and block are None for a gap."""
        pos, gap = 0, None
        while pos < self.size:
            got = self._record(pos)
            if got is None:
                gap = pos if gap is None else gap
                pos = self._next(pos + 1)
                continue
            if gap is not None:
                yield gap, pos, None, None
                gap = None
            head, block, after = got
            yield pos, after, head, block
            pos = after
        if gap is not None:
            yield gap, self.size, None, None


#: Fields of what the reader returns; start and end are byte positions in the archive.
FOUND = "path string, start long, end long, gap boolean, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, sound boolean"


def read_archives(spark: SparkSession, paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives in paths(path), four tasks an archive at hand for balance.

    For a revisit payload is null and its size and digest are those that it states of the payload it refers to. sound
    tells whether the payload's digest is the stated one (null: not stated or not there). A gap has nothing but its place.
    Without payloads they are checked all the same, but not returned.
    """
    small_batches(spark)
    base = qualified(spark, "/")

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def row(path: str, start: int, end: int, head: dict[str, str] | None, block: bytes | None) -> tuple:
        if head is None:
            return path, start, end, True, *(None,) * 8
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head.get("warc-type") == "revisit"
        stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        kind, _, digest = head.get("warc-payload-digest", "").partition(":")
        digest = digest if kind == "sha256" else None
        own = None if revisit else hashlib.sha256(payload).hexdigest()
        size = number(stated.get(b"content-length", b"").decode("ascii", "replace")) if revisit else len(payload)
        sound = None if revisit or digest is None else own == digest
        return path, start, end, False, number(head.get("x-page-id")), head.get("warc-target-uri"), head.get("warc-type"), number(head.get("x-refers-to-page-id")), payload if payloads and not revisit else None, size, digest if revisit else own, sound

    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in FOUND.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, own = place(path if path.startswith("file:") or "://" in path else base.rstrip("/") + path)
                with store.open_input_file(own) as file:
                    rows, size = [], 0
                    for item in Salvage(file, file.size()):
                        rows.append(row(path, *item))
                        size += len(item[3] or b"")
                        if size > 2 << 20 or len(rows) >= 2000:
                            yield pack(rows)
                            rows, size = [], 0
                    if rows:
                        yield pack(rows)

    # a number of partitions that is asked for is kept, so that small lists of large archives aren't read by one task
    return paths.select("path").repartition(max(1, 4 * paths.count()), "path").mapInArrow(work, FOUND)


def archived(pages: DataFrame, to: str | None = None) -> DataFrame:
    """Write pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, gap_bytes.

    gap_bytes: the bytes quarantined in the record's archive (0: the archive is whole); the gaps themselves are logged
    beside the archives, in the folder gaps. Repeated rows are archived each; of rows that share the smallest id of
    equal payloads all are responses. Payloads of any length are streamed into the archive and read back one at a time.
    An empty table gives no rows; further columns are not read. Reading fails if an archive gives back fewer or more
    records than were written to it.
    """
    spark = pages.sparkSession
    to = to or scratch(spark, "warc")
    written = write_archives(pages, to)
    return read_back(read_archives(spark, written, payloads=False), written, f"{to}/gaps")


def read_back(found: DataFrame, written: DataFrame, log: str) -> DataFrame:
    """The records of found, checked against the numbers of records in written(path, records); gaps are written to log."""
    found = stored(found.select("path", "start", "end", "gap", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-found")
    found.filter("gap").select("path", "start", "end").write.mode("overwrite").parquet(log)
    gaps = found.sparkSession.read.schema("path string, start long, end long").parquet(log)
    lost = gaps.groupBy("path").agg(F.sum(F.col("end") - F.col("start")).alias("gap_bytes"))
    read = found.filter("NOT gap").groupBy("path").agg(F.count(F.lit(1)).alias("read"))
    wrong = written.join(read, "path", "left").filter("records <> coalesce(read, 0)").agg(F.count(F.lit(1)).alias("archives"), F.sum("records").alias("wrote"), F.sum(F.coalesce("read", F.lit(0))).alias("read")).first()
    if wrong["archives"]:
        where = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("gap_bytes"), F.lit(0))).first()
        raise ValueError(f"{wrong['archives']} archives gave back {wrong['read']} of {wrong['wrote']} records; {where[1]} bytes of {where[0]} archives are quarantined, see {log}")
    whole = found.filter("NOT gap").drop("gap", "start", "end")
    if lost.isEmpty():
        return whole.drop("path").withColumn("gap_bytes", F.lit(0).cast("long"))
    return whole.join(lost, "path", "left").drop("path").withColumn("gap_bytes", F.coalesce("gap_bytes", F.lit(0).cast("long")))
