"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Tasks read blocks of an archive and emit, for each place that looks like a record, where its successor
would start. Pointer jumping from the start of the file then keeps the reachable ones, so that magic
bytes or whole records inside payloads are rejected. Within a block the chain is followed at once; across
blocks the pointers from block to block are doubled in rounds.

Plain archives (.warc) and archives of one gzip member a record (.warc.gz) are read and written.

Defined results: null html counts as empty; equal payloads share one response, the row with the largest
page_id (null before all others; of rows with the same page_id exactly one), and the others revisit it;
what follows a damaged record of a file is not reachable and not returned; an empty table gives an empty
result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, fresh_path, join_sized, materialize, row_ids
from glossmill.llm.files import RangeFile, byte_blocks, task_file

BLOCK = 4 << 20
#: Payloads of fewer bytes are never stored as revisits.
LEAST = 0
#: Bytes that the search for a header's end reads at a time.
STEP = 1 << 16
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
LENGTH = re.compile(rb"(?i)\r\n[ \t]*content-length[ \t]*:([^\r\n]*)")
PLAIN = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = re.compile(rb"\x1f\x8b\x08")
ROW = ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
SCHEMA = "path string, block long, offset long, successor long, exit long, page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: tuple[int | None] | None) -> bytes:
    """refers_to: nothing for a response; its content is the payload after an HTTP head, that of a revisit the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    content = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to[0])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def info_record() -> bytes:
    content = b"format: WARC File Format 1.1\r\n"
    return b"\r\n".join([b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:info>", f"WARC-Date: {DATE}".encode(), b"Content-Type: application/warc-fields", f"Content-Length: {len(content)}".encode()]) + b"\r\n\r\n" + content + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    own = zlib.compressobj(1, zlib.DEFLATED, 31)
    return own.compress(data) + own.flush()


def fields(header: bytes) -> dict[str, str]:
    out = {}
    for line in header.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") if urn and urn.startswith("<urn:page:") else None


class Content:
    """Takes a record's bytes after its header: cuts an HTTP head off, counts and digests the payload."""

    def __init__(self, own: dict[str, str]):
        self.own, self.left = own, int(own.get("content-length", "-1"))
        if self.left < 0:
            raise ValueError("no Content-Length")
        self.http = own.get("content-type", "").startswith("application/http")
        self.head, self.sha1, self.size, self.stated = b"", hashlib.sha1(), 0, None

    def feed(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        if self.http:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.head[: end + 2])
            self.stated = int(stated[1]) if stated else None
            data, self.head, self.http = self.head[end + 4 :], b"", False
        self.size += len(data)
        self.sha1.update(data)

    def row(self) -> tuple:
        kind = self.own.get("warc-type")
        stated = (self.own.get("warc-payload-digest") or "").removeprefix("sha1:")
        if kind == "revisit":
            return _page(self.own.get("warc-record-id")), kind, self.stated, stated, _page(self.own.get("warc-refers-to"))
        return _page(self.own.get("warc-record-id")), kind, self.size, base64.b32encode(self.sha1.digest()).decode(), None


def _header(file: RangeFile, at: int) -> bytes | None:
    """A record's lines from at on, without the empty line after them, however long they are; None if they don't end."""
    held = bytearray()
    while data := file.read(at + len(held), STEP):
        seen = max(0, len(held) - len(END) + 1)
        held += data
        end = held.find(END, seen)
        if end >= 0:
            return bytes(held[:end])
    return None


class Headers:
    """Where plain records would end. Candidates in one header share its end and its length, so that magic without end is read once."""

    def __init__(self, file: RangeFile):
        self.file, self.start, self.end, self.place, self.length = file, 0, 0, -1, -1

    def successor(self, at: int) -> int | None:
        if not self.start <= at < self.end:
            header = _header(self.file, at)
            self.start, self.end, self.place = at, self.file.size if header is None else at + len(header), -1
            for m in LENGTH.finditer(header or b""):  # the last one counts, as in fields()
                self.place, self.length = at + m.start(), int(m[1]) if m[1].strip().isdigit() else -1
        if self.place < at or self.length < 0:
            return None
        after = self.end + len(END) + self.length
        return after + len(END) if after + len(END) <= self.file.size and self.file.read(after, len(END)) == END else None


def _plain_record(file: RangeFile, at: int) -> tuple:
    """A record that the chain reaches, read as a whole."""
    header = _header(file, at)
    content = Content(fields(header))
    low, length = at + len(header) + len(END), content.left
    for part in range(low, low + length, 1 << 20):
        content.feed(file.read(part, min(1 << 20, low + length - part)))
    return content.row()


def _member_record(file: RangeFile, at: int) -> tuple[int, tuple] | None:
    """A damaged or chance member ends in an error of the decoder, most often in its first bytes."""
    own, place, start, content = zlib.decompressobj(31), at, bytearray(), None
    try:
        while not own.eof:
            data = file.read(place, 1 << 15)
            if not data:
                return None
            place += len(data)
            out = own.decompress(data)
            if content is None:
                seen = max(0, len(start) - len(END) + 1)
                start += out
                if not start.startswith(b"WARC/1."[: len(start)]):
                    return None
                end = start.find(END, seen)
                if end < 0:
                    continue
                content, out = Content(fields(bytes(start[:end]))), bytes(start[end + len(END) :])
            content.feed(out)
    except (zlib.error, ValueError):
        return None
    if content is None or content.left:
        return None
    return place - len(own.unused_data), content.row()


def scan_block(file: RangeFile, start: int, stop: int, zipped: bool) -> list[tuple]:
    """(offset, successor, exit, row) of each candidate that starts in the block; exit: where the chain from it leaves the block.

    A member has to be unpacked to find its end, so that its row is known at once; a plain record is read when it is reached.
    """
    data = file.read(start, stop - start + 16)
    headers, found = Headers(file), []
    for m in (MEMBER if zipped else PLAIN).finditer(data):
        at = start + m.start()
        if at >= stop:
            break
        if zipped:
            parsed = _member_record(file, at)
        else:
            successor = headers.successor(at)
            parsed = None if successor is None else (successor, (None,) * 5)
        if parsed:
            found.append((at, *parsed))
    exits: dict[int, int] = {}
    for offset, successor, _ in reversed(found):
        exits[offset] = exits.get(successor, successor)
    return [(offset, successor, exits[offset], row) for offset, successor, row in found]


def candidates(spark: SparkSession, files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Places that look like records, with their successors, in files(path, size)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in batch.to_pylist():
                file = RangeFile(b["path"])
                found = scan_block(file, b["start"], b["stop"], b["path"].endswith(".gz"))
                file.close()
                rows = [(b["path"], b["block"], o, s, e, *row) for o, s, e, row in found]
                kinds = (pa.string(), *(pa.int64(),) * 4, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return byte_blocks(spark, files, block).mapInArrow(run, SCHEMA)


def _on_chain(group: pa.Table) -> pa.Table:
    """The records of a block that its entry reaches, by pointer jumping."""
    group = group.sort_by("offset")
    offsets, successor = group["offset"].to_numpy(), group["successor"].to_numpy()
    jump = np.searchsorted(offsets, successor)
    jump[(jump == len(offsets)) | (offsets[np.minimum(jump, len(offsets) - 1)] != successor)] = len(offsets)
    jump = np.append(jump, len(offsets))
    reached = np.append(offsets == group["entry"][0].as_py(), False)
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    group = group.filter(pa.array(reached[:-1])).drop_columns(["entry"])
    if not group.num_rows or group["path"][0].as_py().endswith(".gz"):
        return group
    file = RangeFile(group["path"][0].as_py())
    rows = [_plain_record(file, at) for at in group["offset"].to_pylist()]
    file.close()
    for i, name in enumerate(ROW):
        at = group.schema.get_field_index(name)
        group = group.set_column(at, name, pa.array([r[i] for r in rows], group.schema.field(at).type))
    return group


def read_archives(spark: SparkSession, files: DataFrame, block: int = BLOCK) -> DataFrame:
    """The records of files(path, size), those inside payloads left out."""
    seen = materialize(spark, candidates(spark, files, block), "warc-candidates")
    reached = materialize(spark, files.filter("size > 0").select("path", F.lit(0).cast("long").alias("offset")), "warc-reached")
    # Only places where a chain enters a block take part in the rounds.
    doors = seen.select("path", F.col("exit").alias("offset")).unionByName(reached).distinct()
    jump = materialize(spark, seen.select("path", "offset", "exit").join(doors, ["path", "offset"], "left_semi"), "warc-jumps")
    known = reached.count()
    while True:
        step = reached.join(jump, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached = materialize(spark, reached.unionByName(step).distinct(), "warc-reached")
        now = reached.count()
        if now == known:
            break
        known = now
        onward = jump.select("path", F.col("offset").alias("exit"), F.col("exit").alias("onward"))
        jump = materialize(spark, jump.join(onward, ["path", "exit"]).select("path", "offset", F.col("onward").alias("exit")), "warc-jumps")
    entries = seen.select("path", "block", "offset").join(reached, ["path", "offset"]).select("path", "block", F.col("offset").alias("entry"))
    return seen.join(entries, ["path", "block"]).select(*seen.columns, "entry").groupBy("path", "block").applyInArrow(_on_chain, SCHEMA)


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, zipped: bool = True, least: int = LEAST) -> DataFrame:
    """Writes an archive a task of pages(page_id, url, html); (path, size) of each, when the result is materialized."""
    bounded_batches(spark)

    def prepare(batches: Batches) -> Batches:
        for batch in batches:
            payloads = [(x or "").encode() for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_uid"), batch.column("page_id"), batch.column("url"), pa.array([base32_sha1(x) for x in payloads]), pa.array([len(x) for x in payloads], pa.int64()), pa.array([zlib.compress(x, 1) for x in payloads], pa.binary())],
                ["row_uid", "page_id", "url", "digest", "n_bytes", "packed"],
            )

    def write(batches: Batches) -> Batches:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        wrap = member if zipped else bytes
        with task_file(folder, ".warc.gz" if zipped else ".warc") as (name, out):
            size, batch = out.write(wrap(info_record())), first
            while batch is not None:
                for r in batch.to_pylist():
                    refers = None if r["response"] else (r["response_id"],)
                    size += out.write(wrap(record(r["page_id"], r["url"], zlib.decompress(r["packed"]) if r["response"] else b"", r["digest"], r["n_bytes"], refers)))
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["path", "size"])

    source = row_ids(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).select("row_uid", "page_id", "url", "html")
    prepared = materialize(spark, source.mapInArrow(prepare, "row_uid long, page_id long, url string, digest string, n_bytes long, packed binary"), "warc-payloads")
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", (-F.col("row_uid")).alias("turn"))
    firsts = materialize(spark, prepared.groupBy("digest", "n_bytes").agg(F.max(order).alias("first"), F.count("*").alias("copies")), "warc-firsts")
    pages_there = firsts.agg(F.sum("copies")).first()[0] or 0
    # Pages of a payload that very many have, as empty and error pages, are not shuffled.
    chosen = join_sized(prepared, firsts, ["digest", "n_bytes"], "copies", pages_there).select(
        "page_id", "url", "digest", "n_bytes", ((F.col("n_bytes") < least) | (F.col("row_uid") == -F.col("first.turn"))).alias("response"), F.col("first.page_id").alias("response_id"), "packed",
    )
    return chosen.mapInArrow(write, "path string, size long")


def archive_round_trip(spark: SparkSession, pages: DataFrame, zipped: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives of pages."""
    files = materialize(spark, write_archives(spark, pages, fresh_path(spark, "warc-files"), zipped), "warc-list")
    number = lambda c: F.expr(f"try_cast({c} as long)").alias(c)
    return read_archives(spark, files).filter("record_type in ('response', 'revisit')").select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
