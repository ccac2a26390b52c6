"""PNG and PNM images from pixel tables, encoded by strips of rows side by side, and writing them to a folder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


#: Bytes of a strip of rows at about which an image is cut, and the compression level.
STRIP_BYTES, LEVEL = 8 << 20, 6
COLOUR_TYPE = {1: 0, 3: 2, 4: 6}


def _deflate(image: np.ndarray) -> tuple[bytes, int, int]:
    """A strip's rows, unfiltered, as whole blocks of a deflate stream that go on; the checksum and number of its raw bytes."""
    h = len(image)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, -1)], 1).tobytes()
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def _adler_joined(a: int, b: int, n: int) -> int:
    """Adler-32 of two byte strings in a row from that of either; n: bytes of the second. Both sums are modulo 65521."""
    base = 65521
    low = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % base
    high = ((a >> 16) + (b >> 16) + n % base * ((a & 0xFFFF) - 1)) % base
    return high << 16 | low


def _assemble_png(strips: list[tuple[bytes, int, int]], width: int, height: int, channels: int) -> bytes:
    """A PNG of deflated strips in order; each is a data chunk of its own."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    total = 1
    for _, adler, n in strips:
        total = _adler_joined(total, adler, n)
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)
    # The stream's header, the strips' blocks, an empty last block and the checksum of all rows.
    data = [chunk(b"IDAT", b"\x78\x9c"), *[chunk(b"IDAT", s) for s, _, _ in strips], chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total))]
    return b"".join([b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", head), *data, chunk(b"IEND", b"")])


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of rows of pixels with 1, 3 or 4 channels."""
    if image.ndim == 2:
        image = image[:, :, None]
    h, w, channels = image.shape
    rows = strip_rows(w, channels)
    return _assemble_png([_deflate(image[y : y + rows]) for y in range(0, h, rows)], w, h, channels)


def _joined(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def strip_rows(width: int, channels: int) -> int:
    return max(1, STRIP_BYTES // (width * channels))


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit PNG whose rows are stored unfiltered, as encode_png writes them."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, shape = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack(">IIBB", part[:10])
            shape = h, w, {0: 1, 2: 3, 6: 4}[colour]
        body += part if kind == b"IDAT" else b""
        at += n + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], -1)
    return rows[:, 1:].reshape(shape)


def _pnm_head(width: int, height: int, channels: int) -> bytes:
    return f"{'P5' if channels == 1 else 'P6'}\n{width} {height}\n255\n".encode()


def _pnm_body(image: np.ndarray) -> bytes:
    return (image[:, :, :3] if image.shape[2] > 1 else image).astype(np.uint8).tobytes()


def encode_pnm(image: np.ndarray) -> bytes:
    """P5 for one channel, P6 for three; a fourth is left out."""
    if image.ndim == 2:
        image = image[:, :, None]
    h, w, channels = image.shape
    return _pnm_head(w, h, channels) + _pnm_body(image)


def render_images(pixels: DataFrame, width: int, height: int, empty: tuple[int, int, int, int] = (0, 0, 0, 255), kind: str = "png", channels: str = "rgba") -> DataFrame:
    """(frame, image binary) from (frame, iy, ix, r, g, b, a); pixels without a row get the empty colour, frames without any inside no image.

    Strips of rows are drawn and compressed side by side; the task that puts a frame together holds its encoded bytes only.
    """
    fill, n = [empty["rgba".index(c)] for c in channels], len(channels)
    rows = strip_rows(width, n)

    def encode(image: np.ndarray) -> tuple[bytes, int, int]:
        return _deflate(image) if kind == "png" else (_pnm_body(image), 0, 0)

    def blank(strip: int) -> np.ndarray:
        return np.broadcast_to(np.array(fill, np.uint8), (min(rows, height - strip * rows), width, n))

    def draw(table: pa.Table) -> pa.Table:
        frame, strip = table["frame"][0].as_py(), table["strip"][0].as_py()
        image = blank(strip).copy()
        place, colour = table["place"].to_numpy(), table["colour"].to_numpy()
        for k in range(n):
            image.reshape(-1, n)[place, k] = colour >> 8 * k & 255
        body, adler, size = encode(image)
        return pa.table({"frame": pa.array([frame], pa.int32()), "strip": pa.array([strip], pa.int32()), "body": pa.array([body], pa.binary()), "adler": pa.array([adler], pa.int64()), "size": pa.array([size], pa.int64())})

    def assemble(table: pa.Table) -> pa.Table:
        held = {s: (b, a, z) for s, b, a, z in zip(*[table[c].to_pylist() for c in ("strip", "body", "adler", "size")], strict=True)}
        blanks: dict[int, tuple[bytes, int, int]] = {}
        strips = []
        for s in range(-(-height // rows)):
            if s not in held and len(blank(s)) not in blanks:
                blanks[len(blank(s))] = encode(blank(s))
            strips.append(held[s] if s in held else blanks[len(blank(s))])
        image = _assemble_png(strips, width, height, n) if kind == "png" else b"".join([_pnm_head(width, height, n), *[b for b, _, _ in strips]])
        return pa.table({"frame": pa.array([table["frame"][0].as_py()], pa.int32()), "image": pa.array([image], pa.binary())})

    inside = F.col("iy").between(0, height - 1) & F.col("ix").between(0, width - 1)
    # A pixel travels as its place in the strip and its channels in one number.
    strip, colour = F.floor(F.col("iy") / rows).cast("int"), reduce(_joined, [F.shiftleft(F.col(c).cast("int"), 8 * k) for k, c in enumerate(channels)])
    shown = pixels.filter(inside).select("frame", strip.alias("strip"), ((F.col("iy") - strip * rows) * width + F.col("ix")).cast("int").alias("place"), colour.alias("colour"))
    drawn = shown.groupBy("frame", "strip").applyInArrow(draw, "frame int, strip int, body binary, adler long, size long")
    return drawn.groupBy("frame").applyInArrow(assemble, "frame int, image binary")


def name_frames(images: DataFrame, root: str, suffix: str = "png") -> DataFrame:
    """Adds file: root.0000.png and so on."""
    return images.withColumn("file", F.format_string("%s.%04d." + suffix, F.lit(root), F.col("frame")))


class ImageSink(DataSource):
    """df.write.format("skymill_images").save(): writes each row's image to the path in its column file.

    Paths are URIs of any file system that pyarrow opens. A file appears under its own name only when it is complete.
    """

    @classmethod
    def name(cls) -> str:
        return "skymill_images"

    def schema(self) -> str:
        return "file string, image binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ImageWriter([f.name for f in schema.fields])


class _ImageWriter(DataSourceArrowWriter):
    def __init__(self, names: list[str]):
        self.file, self.image = names.index("file"), names.index("image")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs

        for batch in iterator:
            for file, image in zip(batch.column(self.file).to_pylist(), batch.column(self.image).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(file if "://" in file else "file://" + file)
                store.create_dir(path.rpartition("/")[0])
                with store.open_output_stream(f"{path}.part") as stream:
                    stream.write(image)
                store.move(f"{path}.part", path)
        return WriterCommitMessage()
