"""Gadget binary snapshots, formats 1 and 2, as a Spark data source, and a writer of such files for tests and exchange.

A file is a sequence of records, each between two 4-byte length markers: a 256-byte header, then positions, and where
present velocities and ids. Format 2 puts a 16-byte record with a block's name before each. Particles lie type by type.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from ..schema import HEADER, PARTICLES
from .files import open_file, snapshot_files

HEADER_BYTES = 256
#: Rows that one task reads of one file, and rows that it holds at once.
ROWS, HELD_ROWS = 4_000_000, 1 << 18
TYPES = 6


def read_header(path: str) -> dict:
    """The header of one file, with the byte offsets of its data blocks and whether ids are 4 or 8 bytes wide."""
    with open_file(path) as f:
        named = struct.unpack("<i", f.read(4))[0] == 8
        start = 16 + 4 if named else 4
        f.seek(start)
        raw = f.read(HEADER_BYTES)
        npart = struct.unpack_from("<6i", raw, 0)
        mass = struct.unpack_from("<6d", raw, 24)
        time, redshift = struct.unpack_from("<2d", raw, 72)
        nall = struct.unpack_from("<6I", raw, 96)
        num_files = struct.unpack_from("<i", raw, 124)[0]
        box, omega0, omega_l, hubble = struct.unpack_from("<4d", raw, 128)
        n = sum(npart)
        # Format 1 names no block: positions come first, velocities are as wide, ids are narrower.
        widths = {12 * n: "VEL ", 8 * n: "ID  ", 4 * n: "ID  "}
        at, end, blocks = start + HEADER_BYTES + 4, f.size(), {}
        while at < end:
            name = None
            if named:
                f.seek(at + 4)
                name = f.read(4).decode("ascii", "replace")
                at += 16
            f.seek(at)
            size = struct.unpack("<I", f.read(4))[0]
            blocks.setdefault(name if named else "POS " if not blocks else widths.get(size, f"at {at}"), (at + 4, size))
            at += size + 8
    types = max([i + 1 for i in range(TYPES) if npart[i] or nall[i]], default=0)
    return {
        "file": path, "num_types": types, "npart": list(npart[:types]), "nall": list(nall[:types]), "massarr": list(mass[:types]), "time": time, "redshift": redshift,
        "num_files": max(1, num_files), "box_size": box, "omega0": omega0, "omega_lambda": omega_l, "hubble": hubble, "blocks": blocks, "id_width": blocks.get("ID  ", (0, 8 * n))[1] // max(1, n),
    }


class Range(InputPartition):
    """Rows lo to hi of one type in one file; first: rows of the file before that type."""

    def __init__(self, file: str, ptype: int, lo: int, hi: int, header: dict):
        self.file, self.ptype, self.lo, self.hi, self.header = file, ptype, lo, hi, header


def type_ranges(header: dict, wanted: set[int] | None, rows: int) -> list[Range]:
    """A file's rows, cut by type and into ranges; types that are not wanted are never read."""
    out, at = [], 0
    for t, n in enumerate(header["npart"]):
        if wanted is None or t in wanted:
            out += [Range(header["file"], t, at + lo, at + min(n, lo + rows), header) for lo in range(0, n, rows)]
        at += n
    return out


class TakesFilters:
    """For readers of a session that pushes filters to Python sources: those on ptype are taken, all others left to Spark."""

    def pushFilters(self, filters: list):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ptype",):
                self.narrow({f.value})
            elif isinstance(f, In) and f.attribute == ("ptype",):
                self.narrow(set(f.value))
            else:
                yield f


def particle_schema(options: dict) -> str:
    """That of headers with the option header=true; else that of particles, of those columns that the option columns names."""
    if options.get("header", "false") == "true":
        return HEADER
    wanted = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
    if strange := set(wanted) - {c.split()[0] for c in PARTICLES.split(", ")}:
        raise ValueError(f"particles have no columns {sorted(strange)}")
    return ", ".join(c for c in PARTICLES.split(", ") if not wanted or c.split()[0] in wanted)


class GadgetSource(DataSource):
    """spark.read.format("skymill_gadget").load(root): particles.

    Options: header=true: a row for each file instead; columns and types: those that are wanted, by commas, so that others
    are never read; rows: how many of a file a task reads; pushdown=true: the session hands filters to Python sources.
    """

    @classmethod
    def name(cls) -> str:
        return "skymill_gadget"

    def schema(self) -> str:
        return particle_schema(self.options)

    def reader(self, schema: StructType) -> DataSourceReader:
        files = snapshot_files(self.options["path"])
        if schema.names == [c.split()[0] for c in HEADER.split(", ")]:
            return HeaderReader(files, read_header)
        return particle_reader(_Particles, files, read_header, self.options, schema.names)


def particle_reader(kind: type, files: list[str], header: Callable[[str], dict], options: dict, names: list[str]) -> DataSourceReader:
    """A reader of the kind, one that takes filters where the session pushes them: else Spark refuses such a reader."""
    kind = type(kind.__name__, (TakesFilters, kind), {}) if options.get("pushdown", "false") == "true" else kind
    out = kind(files, header, int(options.get("rows", ROWS)), names)
    if options.get("types", ""):
        out.narrow({int(t) for t in options["types"].split(",")})
    return out


class HeaderReader(DataSourceReader):
    def __init__(self, files: list[str], header: Callable[[str], dict]):
        self.files, self.header = files, header

    def read(self, partition):
        for f in self.files:
            h = self.header(f)
            yield tuple(h[k.split()[0]] for k in HEADER.split(", "))


class ParticleReader(DataSourceReader):
    """Ranges of rows of a snapshot's files; only the blocks that the wanted columns need are read, in batches."""

    def __init__(self, files: list[str], header: Callable[[str], dict], rows: int, names: list[str]):
        self.files, self.header, self.rows, self.names = files, header, rows, names
        self.wanted: set[int] | None = None
        columns = {"pos": {"x", "y", "z"}, "vel": {"vx", "vy", "vz"}, "ids": {"id"}}
        self.wants = [k for k, c in columns.items() if c & set(names)]

    def narrow(self, types: set[int]) -> None:
        self.wanted = types if self.wanted is None else self.wanted & types

    def partitions(self) -> list[InputPartition]:
        return [r for f in self.files for r in type_ranges(self.header(f), self.wanted, self.rows)] or [Range("", 0, 0, 0, {})]

    def blocks(self, partition: Range, low: int, high: int) -> dict[str, np.ndarray | None]:
        """pos, vel and ids, as far as wanted, of rows low to high - 1 of the file; None where the file has none."""
        raise NotImplementedError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for low in range(partition.lo, partition.hi, HELD_ROWS):
            high = min(low + HELD_ROWS, partition.hi)
            n, found = high - low, self.blocks(partition, low, high)

            def column(name: str) -> pa.Array:
                if name == "ptype":
                    return pa.array(np.full(n, partition.ptype, np.int32))
                if name == "id":
                    # Ids are kept bit by bit: those of 2**63 and above come out negative.
                    return pa.nulls(n, pa.int64()) if found["ids"] is None else pa.array(found["ids"].reshape(n).astype(np.uint64).view(np.int64))
                block = found["vel" if name[0] == "v" else "pos"]
                return pa.nulls(n, pa.float64()) if block is None else pa.array(block[:, "xyz".index(name[-1])].astype(np.float64))

            yield pa.RecordBatch.from_arrays([column(c) for c in self.names], self.names)


class _Particles(ParticleReader):
    def blocks(self, partition: Range, low: int, high: int) -> dict[str, np.ndarray | None]:
        h, out = partition.header, {}
        kinds = {"pos": ("POS ", "<f4", 3), "vel": ("VEL ", "<f4", 3), "ids": ("ID  ", f"<u{h['id_width'] or 8}", 1)}
        with open_file(partition.file) as f:
            for k in self.wants:
                name, kind, width = kinds[k]
                size = width * np.dtype(kind).itemsize
                held = h["blocks"].get(name)
                out[k] = None if held is None else np.frombuffer(f.read_at((high - low) * size, held[0] + low * size), kind).reshape(high - low, width)
        return out


def snapshot_bytes(counts: list[int], pos: np.ndarray, vel: np.ndarray | None = None, ids: np.ndarray | None = None, box: float = 1.0, redshift: float = 0.0, fmt: int = 1, num_files: int = 1, nall: list[int] | None = None) -> bytes:
    """One file; pos, vel and ids hold the rows of all types in order."""
    counts = [*counts, 0, 0, 0, 0, 0, 0][:TYPES]
    nall = [*(nall or counts), 0, 0, 0, 0, 0, 0][:TYPES]
    head = struct.pack("<6i6d2d2i6I2i4d", *counts, *([0.0] * 6), 1 / (1 + redshift), redshift, 0, 0, *nall, 0, num_files, box, 0.3, 0.7, 0.7).ljust(HEADER_BYTES, b"\0")
    out = []
    for name, body in ((b"HEAD", head), (b"POS ", pos.astype("<f4").tobytes()), (b"VEL ", None if vel is None else vel.astype("<f4").tobytes()), (b"ID  ", None if ids is None else ids.astype("<u8").tobytes())):
        if body is not None:
            out += [struct.pack("<i4sii", 8, name, len(body) + 8, 8) if fmt == 2 else b"", struct.pack("<I", len(body)), body, struct.pack("<I", len(body))]
    return b"".join(out)


def write_snapshot(path: str, *rows, **settings) -> None:
    """Write one file of snapshot_bytes."""
    with open(path, "wb") as f:
        f.write(snapshot_bytes(*rows, **settings))
