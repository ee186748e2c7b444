"""WARC archives: a writer on Spark's text sink and a salvage reader.

Records are plain WARC/1.1 (no compression), assembled by DataFrame functions and written
through Spark's commit protocol.  The reader takes plain and gzip archives, with one
record or many in a member.
After a failed check it searches for the next valid member or version line, goes on
from there, and logs the bytes in between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, ref

#: Fixed value: the date written to records, so that a rerun writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in a file, so that a reader can hold it; a larger record has a file of its own.
FILE_BYTES = 1 << 26
#: Bytes that a gzip member may have inside; a larger one is quarantined.
MEMBER_BYTES = 1 << 30
#: Rows up to which decisions are broadcast (about 60 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Headers that a record has once.
ONCE = ("warc-type", "warc-record-id", "warc-date", "content-length")
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: The empty line after an HTTP head.
HTTP_END = re.compile(rb"\r?\n\r?\n")


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 40 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` to archives below ``path``.

    Of records with equal payloads of ``min_revisit_bytes`` at least, that with the
    smallest id is a response and the others are revisits of it; smaller payloads are
    all responses.  Null html is an empty payload; rows that repeat the smallest id are
    responses all; null ids order last.  Only ids and digests are shuffled to find
    equal payloads; html is shuffled only when there are too many revisits to
    broadcast.  Line ends in urls are percent-encoded; null urls are empty.  Files hold about
    ``FILE_BYTES`` at most, or one larger record; an empty table writes empty files.  Other columns
    are ignored, whatever their names.
    """
    payload = F.coalesce(ref(html_col).cast("string"), F.lit(""))
    rows = pages.select(ref(id_col).cast("long").alias("page_id"), F.coalesce(ref(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", sha1_base32(F.col("payload").cast("binary")))
    key = F.coalesce("page_id", F.lit((1 << 63) - 1))
    scratch = Scratch(pages.sparkSession)
    ids = scratch.keep(rows.select(key.alias("key"), "digest", "size"), "digests")
    firsts = ids.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    decisions = scratch.keep(ids.join(firsts, "digest").where("key > first").select("key", "digest", "first").distinct(), "revisits")
    if decisions.count() <= BROADCAST_ROWS:
        decisions = F.broadcast(decisions)
    marked = rows.withColumn("key", key).join(decisions, ["key", "digest"], "left")
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("size").cast("string"), F.lit(end + end))
    revisit = F.col("first").isNotNull()
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: " + DATE),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(revisit, F.lit("WARC-Profile: " + PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
    ]
    # the sink ends each row with a newline, the last byte of a record
    record = F.concat(F.concat_ws(end, *lines), F.lit(end + end), http, F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit(end + "\r"))
    marked = marked.select("size", "key", "digest", record.alias("value"))
    # files of bounded bytes: pages up to a size that nearly all have go by number; the few larger
    # ones are dealt by size class, and numbered in it
    classes = {r["c"]: r["n"] for r in ids.groupBy(_size_class(F.col("size")).alias("c")).agg(F.count("*").alias("n")).collect()}  # 32 rows at most
    rows_in_all, common = sum(classes.values()), 10
    while sum(n for c, n in classes.items() if c > common) * 100 > rows_in_all:
        common += 1
    small = marked.where(_size_class(F.col("size")) <= common)
    small.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, FILE_BYTES >> common)).text(f"{path}/small")
    large = {c: n for c, n in classes.items() if c > common}
    if large:
        salts = F.element_at(F.create_map(*[F.lit(x) for c, n in large.items() for x in (c, max(1, n * (1 << c) // (8 * FILE_BYTES)))]), F.col("class"))
        dealt = marked.withColumn("class", _size_class(F.col("size"))).where(F.col("class") > common).withColumn("salt", F.pmod(F.xxhash64("key", "digest"), salts).cast("int"))
        place = F.row_number().over(Window.partitionBy("class", "salt").orderBy("key", "digest")) - 1
        in_file = F.greatest(F.floor(F.lit(FILE_BYTES) / F.pow(F.lit(2.0), F.col("class"))), F.lit(1))
        dealt = dealt.withColumn("file", F.floor(place / in_file).cast("int"))
        dealt.select("class", "salt", "file", "value").write.partitionBy("class", "salt", "file").option("lineSep", "\n").text(f"{path}/large")
    scratch.drop()


def _size_class(size: Column) -> Column:
    """The power of two that a size is not above."""
    return F.when(size > 1, F.ceil(F.log2(size.cast("double")))).otherwise(F.lit(0)).cast("int")


#: Longest head of a record, and the largest archive that is read: a value of a row can't be larger.
HEAD_BYTES, ARCHIVE_BYTES = 1 << 16, (1 << 31) - (1 << 10)


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


class Damaged(ValueError):
    pass


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        key = name.decode("utf-8", "replace").strip().lower()
        if key in out and key in ONCE:
            raise Damaged("a header that comes twice")  # the head of a cut-off record runs into the next one
        out[key] = value.decode("utf-8", "replace").strip()
    return out


def _http(head: bytes) -> dict[str, str]:
    """Headers of an HTTP head as servers send it: folded lines go on, lines without a colon are passed over, the first of several counts."""
    out: dict[str, str] = {}
    key = None
    for line in head.split(b"\n")[1:]:
        text = line.decode("utf-8", "replace")
        name, colon, value = text.partition(":")
        if text[:1] in (" ", "\t"):
            if key:
                out[key] = f"{out[key]} {text.strip()}".strip()
        elif colon:
            name = name.strip().lower()
            key = None if name in out else name
            out.setdefault(name, value.strip())
        else:
            key = None
    return out


def _length(text: str | None) -> int | None:
    """A length in ASCII digits, as many as any file needs; else null."""
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


#: Types of records, and names of headers that the format defines.
TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
NAMES = frozenset(
    "warc-record-id content-length warc-date warc-type content-type warc-concurrent-to warc-block-digest warc-payload-digest warc-ip-address warc-refers-to warc-refers-to-target-uri"
    " warc-refers-to-date warc-target-uri warc-truncated warc-warcinfo-id warc-filename warc-profile warc-identified-payload-type warc-segment-number warc-segment-origin-id warc-segment-total-length".split()
)


def parse_record(buffer: bytes, at: int, doubtful: bool = False) -> tuple[Record, int]:
    """The record that begins at a version line, and where it ends; raises Damaged on any failed check.

    Where the bytes around it are ``doubtful``, a record must prove itself: a digest that matches, and a head of defined names and values.
    """
    line, head = buffer.find(b"\r\n", at, at + 64), buffer.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if not buffer.startswith(VERSION, at) or line < 0 or head < 0 or not re.fullmatch(rb"WARC/1\.[0-9]", buffer[at:line]):
        raise Damaged("no version line")
    headers = _headers(buffer[line + 2 : head]) if head > line else {}
    length = _length(headers.get("content-length"))
    if length is None or "warc-type" not in headers:
        raise Damaged("no length or type")
    start = head + 4
    end = start + length
    if buffer[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    record = Record(at, headers, bytes(buffer[start:end]))
    if "application/http" in headers.get("content-type", "") and (cut := HTTP_END.search(record.block)):
        record.http = _http(record.block[: cut.start()])
        record.payload = record.block[cut.end() :]
    else:
        record.payload = record.block
    for header, data in (("warc-block-digest", record.block), ("warc-payload-digest", None if headers["warc-type"] == "revisit" else record.payload)):
        said = headers.get(header, "")
        if data is not None and said.startswith("sha1:") and said[5:] != base64.b32encode(hashlib.sha1(data).digest()).decode():
            raise Damaged(f"{header} does not match")
    if doubtful:
        digests = {"warc-block-digest", *({"warc-payload-digest"} if headers["warc-type"] != "revisit" else set())}
        if not (headers["warc-type"] in TYPES and NAMES.issuperset(headers) and digests & headers.keys() and re.fullmatch(r"<[a-z]+:[!-;=?-~]+>", headers.get("warc-record-id", ""))):
            raise Damaged("a record of a damaged member without proof")
    return record, end + 4


def _inflate(buffer: bytes, at: int, most: int) -> tuple[bytearray, int, str]:
    """The gzip member at a position: its content, where it ends, and what failed.

    A damaged or cut-off member gives what it holds before the damage, and ends where the damage is: the chunk that
    fails is fed again byte by byte.  Content beyond ``most`` bytes is read to find the end, and left out.
    """
    inflate, content, reason = zlib.decompressobj(31), bytearray(), ""

    def keep(piece: bytes) -> None:
        nonlocal reason
        if len(content) + len(piece) > most:
            reason = f"the member's content is over {most} bytes"
        content.extend(piece[: most - len(content)])

    while not inflate.eof:
        waiting = inflate.unconsumed_tail
        data, before = waiting or buffer[at : at + 65536], inflate.copy()
        try:
            piece = inflate.decompress(data, 1 << 20)
        except zlib.error as error:
            # unread input of the failing call lies before ``at`` where it was waiting, else after it
            start = at - len(waiting)
            for i in range(len(data)):
                try:
                    keep(before.decompress(data[i : i + 1]))
                except zlib.error:
                    return content, min(start + i + 1, len(buffer)), f"member: {error}"
            return content, min(start + len(data), len(buffer)), f"member: {error}"
        keep(piece)
        if not (data or piece or inflate.eof):
            return content, len(buffer), "the member is cut off"
        if not waiting:
            at = min(at + 65536, len(buffer))
    return content, at - len(inflate.unused_data), reason


def salvage(buffer: bytes, marks: tuple[bytes, ...] = (VERSION, GZIP), most: int = MEMBER_BYTES, doubtful: bool = False) -> Iterator[Record | tuple[int, int, str]]:
    """Records of an archive, and a (start, end, reason) for each gap of bytes that fail.

    A gzip member holds any number of records, all with the member's offset; a gap among
    them has the member's bounds, and its place in the content in the reason.  A damaged member gives the records
    before the damage that prove themselves, then a gap over the member as far as it was read, with what failed.  A member
    without a valid record is a gap.
    """
    at, size = 0, len(buffer)
    gap, reason = -1, ""
    after = {mark: -1 for mark in marks}  # where each mark was last found

    def seek(start: int) -> int:
        """The next mark from a position on."""
        for mark, found in after.items():
            if found < start:
                found = buffer.find(mark, start)
                after[mark] = size if found < 0 else found
        return min(after.values())

    while at < size:
        broken = ""
        try:
            if GZIP in after and buffer.startswith(GZIP, at):
                member, end, broken = _inflate(buffer, at, most)
                inside: Iterator = salvage(member, (VERSION,), doubtful=bool(broken))
            else:
                record, end = parse_record(buffer, at, doubtful)
                inside = iter((record,))
        except Damaged as error:
            if gap < 0:
                gap, reason = at, str(error)
            # behind the damage of a member its content can be anything, such as copies of what was before
            at = size if doubtful else seek(at + 1)
            continue
        held = []  # gaps before a member's first record
        good = False
        for found in inside:
            if isinstance(found, tuple):
                found = (at, end, f"content {found[0]} to {found[1]}: {found[2]}")
                if not good:
                    held.append(found)
                    continue
            else:
                if not good and gap >= 0:
                    yield gap, at, reason
                    gap = -1
                if not good:
                    yield from held
                good = True
                found.offset = at if len(marks) > 1 else found.offset
            yield found
        if good and broken:
            gap, reason = at, broken
        if not good and gap < 0:
            gap, reason = at, broken or (held[0][2] if held else "an empty member")
        # without a record nothing says that the mark was a member, so the search goes on right behind it
        at = end if good or not broken else seek(at + 1)
    if gap >= 0:
        yield gap, size, reason


READ_SCHEMA = "file string, byte_start long, byte_end long, gap_reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", name or "")
    value = int(found[1]) if found else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def _read(with_payload: bool):
    schema = pa.schema([("file", pa.string()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("gap_reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name, rows, held = path.as_py(), [], 0
                for found in salvage(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    if isinstance(found, tuple):
                        rows.append((name, found[0], found[1], found[2], *[None] * 7))
                    else:
                        h = found.headers
                        revisit = h["warc-type"] == "revisit"
                        length = _length(found.http.get("content-length"))
                        many = length if revisit and length is not None else len(found.payload)
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(found.payload).digest()).decode()
                        rows.append((name, found.offset, None, None, _page(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], many, digest, _page(h.get("warc-refers-to")), found.payload if with_payload else None))
                        held += len(found.payload) if with_payload else 0
                    if len(rows) >= 1000 or held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below a path.

    A gap has ``gap_reason`` and its bytes ``byte_start`` to ``byte_end``; a record has its
    fields, and its payload where asked for.  ``payload_bytes`` and ``payload_digest`` are of
    the full payload, also for revisits, whose own block has the headers alone.  A task
    holds one archive and the content of one gzip member at a time.  Empty files have no rows; an archive over
    ``ARCHIVE_BYTES``, which no row can hold, is a gap as a whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    read = files.where(F.col("length") <= ARCHIVE_BYTES).select("path", "content").mapInArrow(_read(with_payload), READ_SCHEMA)
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    told = {"file": F.col("path"), "byte_start": F.lit(0).cast("long"), "byte_end": F.col("length"), "gap_reason": F.lit(f"the archive is over {ARCHIVE_BYTES} bytes")}
    large = files.where(F.col("length") > ARCHIVE_BYTES).select(*[(told[n] if n in told else F.lit(None).cast(dict(read.dtypes)[n])).alias(n) for n in names])
    return read.unionByName(large)
