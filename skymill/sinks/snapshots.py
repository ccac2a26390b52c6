"""Writing particles as snapshots, Gadget binary or HDF5, a file from each task, on any file system that pyarrow opens."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import AXES
from ..sources.files import locate
from ..sources.gadget import snapshot_bytes

NONE = b"\xff" * 8


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def _type_body(dtype: np.dtype) -> bytes:
    """The datatype message of little-endian numbers."""
    n = dtype.itemsize
    if dtype.kind in "iu":
        return struct.pack("<B3BI2H", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, n, 0, 8 * n)
    exponent, mantissa = {4: (8, 23), 8: (11, 52)}[n]
    return struct.pack("<B3BI2H4BI", 0x11, 0x20, 8 * n - 1, 0, n, 0, 8 * n, mantissa, exponent, 0, mantissa, (1 << exponent - 1) - 1)


def _space_body(shape: tuple[int, ...]) -> bytes:
    return struct.pack("<BBBB4x", 1, len(shape), 0, 0) + b"".join(struct.pack("<Q", s) for s in shape)


class H5Writer:
    """An HDF5 file of groups, numeric attributes and contiguous datasets, in the oldest style, which all readers know."""

    def __init__(self):
        self.out = bytearray(96)

    def _put(self, data: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", k, len(_padded(b)), 0) + _padded(b) for k, b in messages)
        return self._put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def dataset(self, values: np.ndarray) -> int:
        place = self._put(values.tobytes()) if values.size else 2**64 - 1
        return self._header([(0x1, _space_body(values.shape)), (0x3, _type_body(values.dtype)), (0x8, struct.pack("<BBQQ", 3, 1, place, values.nbytes))])

    def group(self, members: dict[str, int], attributes: dict[str, np.ndarray] | None = None) -> int:
        """Members by name; of up to 8 members, which one node of a symbol table holds."""
        names, heap, places = sorted(members), bytearray(8), {}
        for n in names:
            places[n] = len(heap)
            heap += _padded(n.encode() + b"\0")
        heap_at = self._put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, self._put(bytes(heap))))
        entries = b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in names)
        node = self._put((b"SNOD" + struct.pack("<BBH", 1, 0, len(names)) + entries).ljust(8 + 8 * 40, b"\0"))
        used = (struct.pack("<QQ", 0, node) if names else b"") + struct.pack("<Q", places[names[-1]] if names else 0)
        # Room for as many children as the superblock says.
        tree = self._put((b"TREE" + struct.pack("<BBH", 0, 0, bool(names)) + NONE + NONE + used).ljust(24 + 33 * 16, b"\0"))
        messages = [(0x11, struct.pack("<QQ", tree, heap_at))]
        for n, v in (attributes or {}).items():
            parts = [n.encode() + b"\0", _type_body(v.dtype), _space_body(v.shape)]
            messages.append((0xC, struct.pack("<BB3H", 1, 0, *map(len, parts)) + b"".join(map(_padded, parts)) + v.tobytes()))
        return self._header(messages)

    def done(self, root: int) -> bytes:
        head = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHIQQQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, 2**64 - 1, len(self.out), 2**64 - 1, 0, root)
        self.out[: len(head)] = head
        return bytes(self.out)


def hdf5_bytes(counts: list[int], pos: np.ndarray, vel: np.ndarray | None, ids: np.ndarray | None, box: float, redshift: float, num_files: int, nall: list[int], cosmology: dict[str, float]) -> bytes:
    """A snapshot file; rows of all types in order. cosmology: HubbleParam, Omega0 and OmegaLambda."""
    w, groups, at = H5Writer(), {}, 0
    if sum(n > 0 for n in counts) > 6:
        raise ValueError("an HDF5 snapshot is written with up to six types")
    for t, n in enumerate(counts):
        if n:
            sets = {"Coordinates": w.dataset(pos[at : at + n].astype("<f4"))}
            sets |= {} if vel is None else {"Velocities": w.dataset(vel[at : at + n].astype("<f4"))}
            sets |= {} if ids is None else {"ParticleIDs": w.dataset(ids[at : at + n].astype("<u8"))}
            groups[f"PartType{t}"] = w.group(sets)
            at += n
    scalars = {"Redshift": redshift, "Time": 1 / (1 + redshift), "BoxSize": box, **cosmology}
    head = {"NumPart_ThisFile": np.array(counts, "<i4"), "NumPart_Total": np.array(nall, "<u4"), "MassTable": np.zeros(len(counts)), "NumFilesPerSnapshot": np.array(num_files, "<i4")}
    groups["Header"] = w.group({}, head | {k: np.array(v, "<f8") for k, v in scalars.items()})
    groups["Parameters"] = w.group({}, {k: np.array(v, "<f8") for k, v in cosmology.items()})
    return w.done(w.group(groups))


COSMOLOGY = {"HubbleParam": 0.7, "Omega0": 0.3, "OmegaLambda": 0.7}


def write_snapshot(df: DataFrame, root: str, kind: str = "gadget", files: int = 1, box: float = 1.0, redshift: float = 0.0, cosmology: dict[str, float] | None = None) -> list[str]:
    """Write particles (id, ptype, x, y, z and where present vx, vy, vz) as root or root.0, root.1 and so on; returns the files.

    Each task writes one file, of its rows by type; a task that is run again writes the same file. Positions and velocities
    are kept in single precision.
    """
    if kind not in ("gadget", "hdf5"):
        raise ValueError("a snapshot is gadget or hdf5")
    counts = {r["ptype"]: r["count"] for r in df.groupBy("ptype").count().collect()}  # a row for each type
    types = max(counts, default=0) + 1
    if kind == "gadget" and types > 6:
        raise ValueError("a Gadget snapshot has six types")
    nall, settings = [counts.get(t, 0) for t in range(types)], COSMOLOGY | (cosmology or {})
    moving = "vx" in df.columns
    names = ["id", "ptype", *AXES, *([f"v{a}" for a in AXES] if moving else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        n = table.num_rows if table else 0

        def block(columns: list[str]) -> np.ndarray:
            return np.stack([table[c].to_numpy() for c in columns], 1) if table else np.zeros((0, len(columns)))

        ptype = table["ptype"].to_numpy() if table else np.zeros(0, np.int32)
        own = np.bincount(ptype, minlength=types).tolist() if n else [0] * types
        ids = table["id"].to_numpy().view(np.uint64) if table else np.zeros(0, np.uint64)
        pos, vel = block(names[2:5]), block(names[5:]) if moving else None
        file = root + ("" if files == 1 else f".{TaskContext.get().partitionId()}") + (".hdf5" if kind == "hdf5" else "")
        data = hdf5_bytes(own, pos, vel, ids, box, redshift, files, nall, settings) if kind == "hdf5" else snapshot_bytes(own, pos, vel, ids, box, redshift, 1, files, nall)
        store, path = locate(file)
        store.create_dir(path.rpartition("/")[0])
        with store.open_output_stream(path) as stream:
            stream.write(data)
        yield pa.RecordBatch.from_pydict({"file": [file]})

    dealt = df.select(*names).repartition(files, "id").sortWithinPartitions("ptype", "id")
    return sorted(r["file"] for r in dealt.mapInArrow(run, "file string").collect())  # a row for each file
