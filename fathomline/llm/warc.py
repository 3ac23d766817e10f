"""Web archives with a two-level capture index.

Captures are sorted by a key that begins with the reversed host. Every task writes one archive of its key
range, one gzip member a record, the index lines of its captures in compressed blocks, and a sparse
directory with the first key of each block. A look-up finds the archive by its first key, the block by a
binary search in the directory, the line by one in the block, and reads just the record's bytes.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.llm.words import map_batches
from fathomline.session import fresh_path
from fathomline.sources.tables import stage

# Payloads from this size on are stored once.
LEAST_SHARED = 100
# Payload bytes of an archive, and captures of an index block.
ARCHIVE_BYTES = 16 * 1024**2
BLOCK_LINES = 256
# First keys of all archives are sent to the tasks of a look-up; more bytes than this are an error.
ROUTING_BYTES = 64 * 1024**2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COLUMNS = "archive string, first_key string, first_page long, captures long"
_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def capture_key(url: Column) -> Column:
    """Reversed host, then port, path and query: captures of a site and its subdomains lie together.

    Letters of the host count as lower case, blanks, tabs and line ends are percent-encoded, and what
    has no host keeps its text behind an empty one. A null URL has the key of an empty text.
    """
    text = F.coalesce(url, F.lit(""))
    for code in (0x09, 0x0A, 0x0D, 0x20):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(.*)$"
    host = F.lower(F.regexp_extract(text, pattern, 1))
    rest = F.when(host == "", text).otherwise(F.regexp_extract(text, pattern, 2))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _record(page: int | None, url: str, kind: str, digest: str, first: int | None, size: int, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """WARC headers, full payload size and the stored payload of one gzip member."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, size, payload


def _page(text: str) -> int | None:
    return int(text) if text else None


def _order(key: bytes, page: int | None) -> tuple[bytes, bool, int]:
    return key, page is not None, page or 0


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _at(root)
        # a name of its own for each attempt: what a lost task has left behind is never referred to
        name = f"{folder}/archive-{uuid.uuid4().hex}"
        archive = index = directory = first = None
        offset = index_at = captures = 0
        lines: list[str] = []

        def flush() -> None:
            nonlocal index_at
            block = gzip.compress("".join(lines).encode(), mtime=0)
            key, page = lines[0].split("\t")[:2]
            index.write(block)
            directory.write(f"{key}\t{page}\t{index_at}\t{len(block)}\n".encode())
            index_at += len(block)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    store.create_dir(folder, recursive=True)
                    archive, index, directory = (
                        store.open_output_stream(name + end, compression=None) for end in (".warc.gz", ".cdx.gz", ".idx")
                    )
                    first = row["key"], row["page_id"]
                revisit = row["first"] is not None and row["first"] != row["page_id"]
                kind = "revisit" if revisit else "response"
                member = gzip.compress(
                    _record(row["page_id"], row["uri"], kind, row["digest"], row["first"], row["size"], row["payload"]),
                    compresslevel=6, mtime=0,
                )
                archive.write(member)
                page = "" if row["page_id"] is None else row["page_id"]
                lines.append(f"{row['key']}\t{page}\t{offset}\t{len(member)}\t{kind}\n")
                offset += len(member)
                captures += 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if archive is not None:
            if lines:
                flush()
            for file in (archive, index, directory):
                file.close()
            yield pa.record_batch(
                [
                    pa.array([f"{root}/{name.rsplit('/', 1)[1]}"]), pa.array([first[0]]),
                    pa.array([first[1]], pa.int64()), pa.array([captures], pa.int64()),
                ],
                names=["archive", "first_key", "first_page", "captures"],
            )

    return run


def write(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``root`` and return the table of archives.

    (archive, first_key, first_page, captures): path without ending, first capture and number of captures. A
    null page has an empty payload and a null URL an empty target. Of captures with equal payloads of at
    least 100 bytes the one of the smallest page_id is a response, the others are revisits that refer to
    it; rows with that same page_id are responses too, rows without page_id are revisits where any id
    exists. Other columns are ignored; an empty table gives no archive.
    """
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    narrow = stage(rows.select("page_id", "size", "digest"), "payloads")
    firsts = stage(
        narrow.where(F.col("size") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("_digest"), "first"),
        "payload-firsts",
    )
    total = narrow.agg(F.sum("size")).first()[0] or 0
    joined = rows.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("size") >= LEAST_SHARED), "left")
    payload = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.lit(b"")).otherwise(
        F.col("payload")
    )
    ready = joined.select(
        capture_key(F.col("url")).alias("key"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("uri"),
        "page_id", "size", "digest", "first", payload.alias("payload"),
    )
    archives = max(1, -(-total // ARCHIVE_BYTES))
    dealt = ready.repartitionByRange(archives, "key", "page_id").sortWithinPartitions("key", "page_id")
    return stage(dealt.transform(map_batches, _writer(root), _COLUMNS), "archives")


class _Archive:
    """One open archive with its directory."""

    def __init__(self, path: str):
        store, base = _at(path)
        self._index, self._data = (store.open_input_file(base + end) for end in (".cdx.gz", ".warc.gz"))
        with store.open_input_stream(base + ".idx", compression=None) as file:
            rows = [line.split("\t") for line in file.read().decode().split("\n") if line]
        self._blocks = [(int(offset), int(length)) for _, _, offset, length in rows]
        self._firsts = [_order(key.encode(), _page(page)) for key, page, _, _ in rows]
        self._held: tuple[int, list[tuple], list[list[str]]] | None = None

    def _block(self, number: int) -> tuple[list[tuple], list[list[str]]]:
        if self._held is None or self._held[0] != number:
            offset, length = self._blocks[number]
            text = gzip.decompress(self._index.read_at(length, offset)).decode()
            rows = [line.split("\t") for line in text.split("\n") if line]
            self._held = number, [_order(r[0].encode(), _page(r[1])) for r in rows], rows
        return self._held[1:]

    def records(self, key: bytes, page: int | None) -> Iterator[bytes]:
        """The stored bytes of all captures with this key and page."""
        wanted = _order(key, page)
        number = max(0, bisect.bisect_left(self._firsts, wanted) - 1)
        while number < len(self._firsts) and self._firsts[number] <= wanted:
            orders, rows = self._block(number)
            at = bisect.bisect_left(orders, wanted)
            while at < len(orders) and orders[at] == wanted:
                yield self._data.read_at(int(rows[at][3]), int(rows[at][2]))
                at += 1
            if at < len(orders):
                return
            number += 1


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, archive = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["archive"] != path:
                path, archive = row["archive"], _Archive(row["archive"])
            for data in archive.records(row["key"].encode(), row["page_id"]):
                headers, size, payload = read_record(data)
                kind = headers["WARC-Type"]
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                page = _page(headers["WARC-Record-ID"][len("<urn:page:") : -1])
                refers = headers.get("WARC-Refers-To")
                out.append((page, size, digest, kind, _page(refers[len("<urn:page:") : -1]) if refers else None, payload))
        columns = list(zip(*out)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
        )


def look_up(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """Captures of ``wanted`` (page_id, url): one row for each record with that page and URL.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, payload); size and digest are those of
    the full payload, ``payload`` is empty for revisits. Pages that no archive holds give no row; rows of
    ``wanted`` that repeat count once.
    """
    spark = archives.sparkSession
    size = archives.agg(F.sum(F.octet_length("first_key") + F.octet_length("archive") + 16)).first()[0] or 0
    if size > ROUTING_BYTES:
        raise ValueError(f"{size} bytes of first keys; look up in parts of the archives")
    rows = sorted((_order(r.first_key.encode(), r.first_page), r.archive) for r in archives.collect())
    routing = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, paths = routing.value
        for batch in batches:
            keys, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[], [], []]
            for key, page in zip(keys, pages):
                order = _order(key.encode(), page)
                # equal captures may go on from one archive into the next ones
                last = bisect.bisect_right(firsts, order)
                first = max(0, bisect.bisect_left(firsts, order) - 1)
                for path in paths[first:last]:
                    out[0].append(path), out[1].append(key), out[2].append(page)
            yield pa.record_batch(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                names=["archive", "key", "page_id"],
            )

    asked = wanted.select(capture_key(F.col("url").cast("string")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    routed = asked.distinct().transform(map_batches, route, "archive string, key string, page_id long")
    # A fixed number: the rows are small but the reads behind them are not, so sizes must not merge them.
    # Archives have about the same size, so their look-ups are spread evenly.
    dealt = routed.repartition(max(1, len(rows)), "archive").sortWithinPartitions("archive", "key", "page_id")
    return dealt.transform(map_batches, _looked_up, _FOUND)
