"""Length-delimited binary records of token ids, with a separate offset index.

A record is: length (u64), masked CRC-32C of the length (u32), payload, masked CRC-32C of the payload (u32);
all little-endian, the framing that TFRecord readers expect. The payload is doc_id (i64, or the least i64
for null), id width in bytes (u8), then the ids. The index of a file holds, for each record, its offset (u64)
and its payload's length (u64), so that a reader may fetch records in any order.

Documents lie in ascending doc_id order, within a file and from file to file; null ids come first and rows
with equal doc_id follow each other by a checksum of their ids and the ids. A null or empty text gives a record that holds
only the end id. An empty table gives no records. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, shared_root, shuffle_partitions, slices, text_list
from .wordids import word_encoder

NO_ID = -(1 << 63)
LANE = 64
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8")])
READ_BYTES = 8 << 20


@cache
def _byte_table() -> np.ndarray:
    """CRC-32C (polynomial 0x82F63B78, reflected) of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


def _advance(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


@cache
def _shift_tables(power: int) -> np.ndarray:
    """Tables that carry a CRC state over 2**power zero bytes, a table for each byte of the state."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    if power == 0:
        return _byte_table()[states & 255] ^ (states >> 8)
    half = _shift_tables(power - 1)
    return _advance(_advance(states, half), half)


def _carry(state: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each state after so many zero bytes."""
    state, n_bytes, power = state.copy(), n_bytes.copy(), 0
    while n_bytes.any():
        odd = (n_bytes & 1).astype(bool)
        if odd.any():
            state[odd] = _advance(state[odd], _shift_tables(power))
        n_bytes >>= 1
        power += 1
    return state


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string, all at once: lanes of LANE bytes run side by side, then are joined by shifts."""
    lengths = np.array([len(p) for p in parts], np.int64)
    lanes = np.maximum(1, -(-lengths // LANE))
    ends = np.cumsum(lanes)
    # Zero bytes before a string leave a zero state as it is, so each string is padded in front.
    data = np.frombuffer(b"".join([b"\0" * int(n * LANE - k) + p for n, k, p in zip(lanes, lengths, parts, strict=True)]), np.uint8)
    table = _byte_table()
    state = np.zeros(int(ends[-1]) if len(parts) else 0, np.uint32)
    columns = np.ascontiguousarray(data.reshape(-1, LANE).T)
    for column in columns:
        low = state.astype(np.uint8)
        low ^= column
        state >>= np.uint32(8)
        state ^= table.take(low)
    after = (np.repeat(ends, lanes) - 1 - np.arange(len(state))) * LANE
    state = _carry(state, after)
    joined = np.bitwise_xor.reduceat(state, ends - lanes) if len(parts) else state
    return joined ^ _carry(np.full(len(parts), 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that checksums of data that hold checksums stay sound."""
    return ((crc >> np.uint32(15) | crc << np.uint32(17)).astype(np.uint64) + 0xA282EAD8 & 0xFFFFFFFF).astype(np.uint32)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The records of the payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_crcs, body_crcs = masked(crc32c(heads)), masked(crc32c(payloads))
    return [h + struct.pack("<I", a) + p + struct.pack("<I", b) for h, a, p, b in zip(heads, head_crcs.tolist(), payloads, body_crcs.tolist(), strict=True)]


def unframe(data: bytes) -> list[bytes]:
    """The payloads of whole records; ValueError if a length or checksum is wrong."""
    heads, payloads, crcs, at = [], [], [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + n + 16 > len(data):
            raise ValueError(f"a record at {at} is cut off")
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        crcs.append((struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + n)[0]))
        at += n + 16
    got = list(zip(masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist(), strict=True))
    if got != crcs:
        raise ValueError("a record's checksum is wrong")
    return payloads


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def encode_documents(docs: DataFrame, model_json: str, end_id: int, bounds: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, width, tie, bucket): packed ids of every whole text, with end_id after them.

    bucket: how many bounds lie below doc_id. A bound that stands there m times belongs to an id of very many rows; these
    are dealt to m buckets by the range of tie, a checksum of the ids that orders rows with equal doc_id.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = word_encoder(model_json)
        end = end_id.to_bytes(encoder.width, "little")
        ids = [x + end for x in encoder.encode_batch(text_list(batch.column(1)))]
        keys = [NO_ID if k is None else k for k in batch.column(0).to_pylist()]
        tie, edges = np.array([zlib.crc32(x) for x in ids], np.int64), np.array(bounds, np.int64)
        first, last = (np.searchsorted(edges, np.array(keys, np.int64), side) for side in ("left", "right"))
        bucket = (first + (np.maximum(last - first, 1) * tie >> 32)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([encoder.width] * len(ids), pa.int32()), pa.array(tie), pa.array(bucket)], ["doc_id", "ids", "width", "tie", "bucket"])

    return map_rows(docs, [id_col, text_col], run, "doc_id long, ids binary, width int, tie long, bucket int", keeps=True)


def write_records(encoded: DataFrame, n: int, folder: str) -> DataFrame:
    """Write one record file and one index for each range of doc_id; returns the manifest (bucket, file, n_records, n_ids).

    A task writes under a name of its own and the manifest names what finished tasks wrote, so a repeated or
    lost task leaves at most files that nothing refers to. One shuffle, of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name = f"part-{uuid.uuid4().hex}"
        offset = n_records = n_ids = 0
        bucket_id, data, index = None, None, None
        for batch in slices(batches):
            bucket_id = batch.column(0)[0].as_py()
            if data is None:
                data, index = store.open_output_stream(f"{base}/{name}.rec"), store.open_output_stream(f"{base}/{name}.idx")
            widths, ids = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            keys = [NO_ID if i is None else i for i in batch.column(1).to_pylist()]
            records = frame([struct.pack("<qB", k, w) + x for k, w, x in zip(keys, widths, ids, strict=True)])
            sizes = np.array([len(r) for r in records], np.uint64)
            entries = np.zeros(len(records), INDEX)
            entries["offset"], entries["length"] = offset + np.cumsum(sizes) - sizes, sizes - np.uint64(16)
            data.write(b"".join(records))
            index.write(entries.tobytes())
            offset += int(sizes.sum())
            n_records += len(records)
            n_ids += sum(len(x) // w for x, w in zip(ids, widths, strict=True))
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket_id], pa.int32()), "file": [f"{folder}/{name}"], "n_records": [n_records], "n_ids": [n_ids]})

    dealt = encoded.select("bucket", "doc_id", "ids", "width", "tie").repartitionById(n, F.col("bucket"))
    return dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids").mapInArrow(run, "bucket int, file string, n_records long, n_ids long")


def id_bounds(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """Up to n-1 values that split the ids into ranges of like counts, from a scan of that column alone; an id of many rows comes several times."""
    shares = [i / n for i in range(1, n)]
    if not shares:
        return []
    got = docs.agg(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), shares, 100 * n).alias("b")).first()["b"]
    return sorted(got or [])


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, with_ids, (ids binary, width), from the files a manifest names.

    start: ids of all records before it; ids_crc32: over ids as u32. Every length and checksum is verified. Files are read
    by their index, in blocks of about READ_BYTES.
    """
    n = shuffle_partitions(manifest.sparkSession)
    # One row for each file: as many as the write had tasks.
    before = F.sum("n_ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("bucket", "file", F.coalesce(before, F.lit(0)).alias("before")).repartitionById(n, F.col("bucket") % n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, base = _open(file)
                with store.open_input_stream(f"{base}.idx") as stream:
                    index = np.frombuffer(stream.read(), INDEX)
                ends = (index["offset"] + index["length"] + np.uint64(16)).astype(np.int64)
                with store.open_input_stream(f"{base}.rec") as stream:
                    at = done = 0
                    while at < len(index):
                        to = max(at + 1, int(np.searchsorted(ends, done + READ_BYTES, "right")))
                        payloads = unframe(stream.read(int(ends[to - 1]) - done))
                        at, done = to, int(ends[to - 1])
                        keys = [struct.unpack_from("<qB", p) for p in payloads]
                        counts = np.array([(len(p) - 9) // w for p, (_, w) in zip(payloads, keys, strict=True)], np.int64)
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        crc = [zlib.crc32(np.frombuffer(p, f"<u{w}", offset=9).astype("<u4")) for p, (_, w) in zip(payloads, keys, strict=True)]
                        out = {"doc_id": pa.array([None if k == NO_ID else k for k, _ in keys], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())}
                        if with_ids:
                            out |= {"ids": pa.array([p[9:] for p in payloads], pa.binary()), "width": pa.array([w for _, w in keys], pa.int32())}
                        yield pa.RecordBatch.from_pydict(out)

    return files.select("file", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary, width int" * with_ids)


def record_files(docs: DataFrame, model_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents, write their record files to the shared folder and return the manifest as a table."""
    folder = f"{shared_root(docs.sparkSession)}/records"
    store, base = _open(folder)
    store.create_dir(base)
    bounds = id_bounds(docs, id_col, shuffle_partitions(docs.sparkSession))
    # What each task wrote comes back as Spark's own commit messages do: a row for each file, none for each record.
    written = write_records(encode_documents(docs, model_json, end_id, bounds, id_col, text_col), len(bounds) + 1, folder)
    return docs.sparkSession.createDataFrame(written.collect(), written.schema)
