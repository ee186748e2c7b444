"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of segments.  A segment (little-endian) is

====================  ======================================================================
magic                 8 bytes ``PMTKPFR1``
header                u64 body bytes, i64 segment number, u32 documents, u64 ids, u32 ids in a block, u32 blocks
documents             i64 ids, u8 null marks, u32 numbers of ids
block index           u32 start of each block in the block area, and its end
blocks                u32 least id, u8 width, u16 exceptions; the packed differences;
                      u16 places and u32 differences of the exceptions
checksum              u32 crc32 of all bytes after the magic
end                   one newline, which the text sink writes
====================  ======================================================================

A block's width is that of a percentile of its differences to the least id; larger
differences are exceptions, whose packed bits are zero.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import small_batches, tidy
from .storage import materialise, ref
from .tokens import CACHED, encoder

MAGIC = b"PMTKPFR1"
HEADER = struct.Struct("<QqIQII")
BLOCK = struct.Struct("<IBH")
#: Ids in a block, the percentile that sets its width, and ids after which a segment ends.
BLOCK_IDS, PERCENTILE, SEGMENT_IDS = 1024, 95, 1 << 20
#: Segments in a file, so that a reader can hold one: about 16 MB, unless a document alone is longer.
FILE_SEGMENTS = 8


def pack_bits(values: np.ndarray, width: int) -> bytes:
    return packed_rows(values[None, :], width).tobytes()


def packed_rows(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each row's values, end to end: one row of bytes for each."""
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, count=width, bitorder="little").reshape(len(values), -1), axis=1, bitorder="little")


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint32)
    groups = -(-count // 8)  # eight values fill as many bytes as a value has bits
    padded = bytes(data).ljust(groups * width + 8, b"\0")
    out = np.empty((groups, 8), np.uint32)
    for i in range(8):
        byte, bit = divmod(i * width, 8)
        words = np.ndarray(groups, "<u8", padded, byte, (width,))
        out[:, i] = (words >> np.uint64(bit)) & np.uint64((1 << width) - 1)
    return out.ravel()[:count]


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    least = ids.min()
    rest = ids - least
    at = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, at)[at]).bit_length()
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    exceptions = rest[out].astype("<u4").tobytes()
    rest[out] = 0
    return BLOCK.pack(int(least), width, len(out)) + pack_bits(rest, width) + out.astype("<u2").tobytes() + exceptions


def encode_blocks(ids: np.ndarray, block_ids: int, percentile: float = PERCENTILE) -> list[bytes]:
    """``encode_block`` of consecutive blocks; full ones of one width are packed together."""
    full = len(ids) // block_ids
    grid = ids[: full * block_ids].reshape(full, block_ids)
    out: list[bytes] = [b""] * full
    if full:
        least = grid.min(axis=1)
        rest = grid - least[:, None]
        at = min(block_ids - 1, int(block_ids * percentile / 100))
        widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1]
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            values = rest[own]
            row, place = np.nonzero(values >> np.uint32(width)) if width < 32 else (np.zeros(0, np.int64),) * 2
            exceptions = values[row, place].astype("<u4")
            values[row, place] = 0
            packed, edge = packed_rows(values, width), np.searchsorted(row, np.arange(len(own) + 1)).tolist()
            place = place.astype("<u2")
            for i, k in enumerate(own.tolist()):
                a, b = edge[i], edge[i + 1]
                out[k] = BLOCK.pack(int(least[k]), width, b - a) + packed[i].tobytes() + place[a:b].tobytes() + exceptions[a:b].tobytes()
    if len(ids) > full * block_ids:
        out.append(encode_block(ids[full * block_ids :], percentile))
    return out


def decode_block(data: bytes, at: int, count: int) -> np.ndarray:
    least, width, many = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    size = (count * width + 7) // 8
    ids = unpack_bits(data[at : at + size], count, width)
    at += size
    if many:
        ids[np.frombuffer(data, "<u2", many, at)] = np.frombuffer(data, "<u4", many, at + 2 * many)
    return ids + np.uint32(least)


def decode_blocks(data: bytes | memoryview, starts: list[int], count: int, block_ids: int) -> np.ndarray:
    """``decode_block`` of consecutive blocks; full ones of one width are unpacked together."""
    full = count // block_ids if block_ids % 8 == 0 else 0
    grid = np.empty((full, block_ids), np.uint32)
    heads = [BLOCK.unpack_from(data, at) for at in starts[:full]]
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths).tolist():
        own, size = np.flatnonzero(widths == width), block_ids * width // 8
        packed = b"".join([data[starts[k] + BLOCK.size : starts[k] + BLOCK.size + size] for k in own.tolist()])
        grid[own] = unpack_bits(packed, len(own) * block_ids, width).reshape(-1, block_ids)
    for k, (least, width, many) in enumerate(heads):
        if many:
            at = starts[k] + BLOCK.size + block_ids * width // 8
            grid[k, np.frombuffer(data, "<u2", many, at)] = np.frombuffer(data, "<u4", many, at + 2 * many)
    grid += np.array([h[0] for h in heads], np.uint32)[:, None]
    rest = [decode_block(data, starts[k], min(block_ids, count - k * block_ids)) for k in range(full, len(starts))]
    return np.concatenate([grid.ravel(), *rest])


def encode_segment(number: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    blocks = encode_blocks(ids, block_ids)
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u4").tobytes()
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(counts, "<u4").tobytes()
    body = table + index + b"".join(blocks)
    head = HEADER.pack(len(body), number, len(doc_ids), len(ids), block_ids, len(blocks))
    return MAGIC + head + body + struct.pack("<I", zlib.crc32(head + body))


def decode_segments(data: bytes | memoryview) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """(segment number, document ids, numbers of ids, ids) of each segment of a file."""
    at = 0
    while at < len(data):
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        start = at + len(MAGIC)
        size, number, docs, ids, block_ids, blocks = HEADER.unpack_from(data, start)
        body = start + HEADER.size
        end = body + size
        if zlib.crc32(data[start:end]) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError(f"the checksum of the segment at byte {at} does not match")
        doc_ids = np.frombuffer(data, "<i8", docs, body).tolist()
        nulls = data[body + 8 * docs : body + 9 * docs]
        counts = np.frombuffer(data, "<u4", docs, body + 9 * docs)
        index = np.frombuffer(data, "<u4", blocks + 1, body + 13 * docs)
        area = body + 13 * docs + 4 * (blocks + 1)
        yield number, [None if x else d for d, x in zip(doc_ids, nulls)], counts, decode_blocks(data, (area + index[:-1].astype(np.int64)).tolist(), ids, block_ids)
        at = end + 4 + 1


def _segments(vocabulary: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        partition, made = TaskContext.get().partitionId(), 0
        doc_ids, counts, held, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal made, size
            content = encode_segment((partition << 32) + made, doc_ids, counts, np.frombuffer(b"".join(held), "<u4").astype(np.uint32))
            made, size = made + 1, 0
            for x in (doc_ids, counts, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                doc_ids.append(doc_id)
                counts.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= SEGMENT_IDS:
                    yield done()
        if doc_ids:
            yield done()

    return tidy(run, CACHED)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Write the ids of all texts, each with ``end_id`` appended, to files in ascending id order.

    Null texts are empty, null ids come first, rows of equal ids follow a hash of the
    text, repeated rows are written each; very long texts are written whole; an empty table
    writes no segment; other columns are ignored, whatever their names.  Rows are dealt out by ranges of id and sorted there, so segment numbers
    (partition, then place in it) ascend with ids.
    """
    texts = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    order = [F.col("doc_id"), F.xxhash64("text")]
    content = texts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(vocabulary, end_id), "content binary")
    # the text sink writes the bytes of a row as they are, and a newline
    content.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _decode(with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for number, doc_ids, counts, ids in decode_segments(memoryview(content.as_buffer())):
                    ends = np.cumsum(counts.astype(np.int64))
                    data, starts = ids.astype("<u4").tobytes(), ends - counts
                    crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    held = [ids[a:b].astype(np.int64) for a, b in zip(starts.tolist(), ends.tolist())] if with_ids else [None] * len(crcs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64()), pa.array(held, pa.list_(pa.int64()))],
                        names=["segment", "doc_id", "start_in_segment", "n_tokens", "ids_crc32", "ids"],
                    )

    return tidy(run)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Files below a path -> (segment, doc_id, start_in_segment, n_tokens, ids_crc32, ids)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(_decode(with_ids), "segment long, doc_id long, start_in_segment long, n_tokens long, ids_crc32 long, ids array<long>")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, segment) of all files: ``start`` counts the ids of all documents before.

    Segments are added up in one window: a row for each million ids.
    """
    rows = materialise(read_tokens(spark, path).drop("ids"), "tokens")
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("segment").agg(F.sum("n_tokens").alias("ids")).select("segment", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, "segment").select("doc_id", (F.col("before") + F.col("start_in_segment")).alias("start"), "n_tokens", "ids_crc32", "segment")
