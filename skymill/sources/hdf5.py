"""HDF5 snapshots as a Spark data source, on any file system that pyarrow knows; the format is read in plain Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from ..schema import HEADER
from .files import snapshot_files
from .gadget import HeaderReader, ParticleReader, Range, particle_reader, particle_schema
from .h5file import H5File

#: Types are looked for up to this number.
MAX_TYPES = 32
#: Where simulation codes keep their cosmology: group and attributes of scale factor, H0, matter, dark energy and h.
CONVENTIONS = ("SWIFT", "GADGET4", "AREPO", "LEGACY")


def read_header(path: str) -> dict:
    """The header of one file: counts by type as far as the file's own attribute lists them, else from the groups there are."""
    with H5File(path) as f:
        a = f["Header"].attrs
        have = [t for t in range(MAX_TYPES) if f"PartType{t}" in f]
        types = max(have, default=0) + 1
        npart = [int(n) for n in np.ravel(a["NumPart_ThisFile"])] if "NumPart_ThisFile" in a else [f[f"PartType{t}/Coordinates"].shape[0] if t in have else 0 for t in range(types)]
        redshift = float(np.ravel(a["Redshift"])[0])

        def one(name: str) -> float | None:
            return float(np.ravel(a[name])[0]) if name in a else None

        return {
            "file": path, "num_types": len(npart), "npart": npart, "nall": [int(n) for n in np.ravel(a["NumPart_Total"])] if "NumPart_Total" in a else npart, "massarr": [float(m) for m in np.ravel(a["MassTable"])] if "MassTable" in a else [],
            "time": 1 / (1 + redshift), "redshift": redshift, "num_files": int(one("NumFilesPerSnapshot") or 1), "box_size": one("BoxSize"), "omega0": one("Omega0"), "omega_lambda": one("OmegaLambda"), "hubble": one("HubbleParam"),
        }


def read_cosmology(path: str, convention: str = "GADGET4") -> tuple[float, float, float, float, float]:
    """(scale factor, H0, omega_m, omega_lambda, h) by the named convention."""
    if convention not in CONVENTIONS:
        raise ValueError(f"convention is one of {CONVENTIONS}")
    with H5File(path) as f:
        head = f["Header"].attrs

        def one(attrs: dict, name: str) -> float:
            return float(np.ravel(attrs[name])[0])

        if convention == "SWIFT":
            c = f["Cosmology"].attrs
            h = one(c, "h")
            return one(head, "Scale-factor"), 100 * h, one(c, "Omega_b") + one(c, "Omega_cdm"), one(c, "Omega_lambda"), h
        attrs = head if convention == "LEGACY" else f["Parameters"].attrs
        h = one(attrs, "HubbleParam")
        return one(head, "Time"), 100 * h, one(attrs, "Omega0"), one(attrs, "OmegaLambda"), h


class Hdf5Source(DataSource):
    """spark.read.format("skymill_hdf5").load(root): particles; options as for the binary format."""

    @classmethod
    def name(cls) -> str:
        return "skymill_hdf5"

    def schema(self) -> str:
        return particle_schema(self.options)

    def reader(self, schema: StructType) -> DataSourceReader:
        files = snapshot_files(self.options["path"], ".hdf5")
        if schema.names == [c.split()[0] for c in HEADER.split(", ")]:
            return HeaderReader(files, read_header)
        return particle_reader(_Particles, files, read_header, self.options, schema.names)


class _Particles(ParticleReader):
    def blocks(self, partition: Range, low: int, high: int) -> dict[str, np.ndarray | None]:
        before = sum(partition.header["npart"][: partition.ptype])
        names = {"pos": "Coordinates", "vel": "Velocities", "ids": "ParticleIDs"}
        with H5File(partition.file) as f:
            group = f[f"PartType{partition.ptype}"]
            return {k: group[names[k]].rows(low - before, high - before) if names[k] in group else None for k in self.wants}
