"""Opening files on any file system that pyarrow knows: local paths, or URIs of HDFS, S3, GCS and others."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def is_file(path: str) -> bool:
    store, name = locate(path)
    return store.get_file_info(name).type == fs.FileType.File


def open_file(path: str) -> pa.NativeFile:
    """The file for reads at any place. FileNotFoundError if there is none."""
    store, name = locate(path)
    return store.open_input_file(name)


def snapshot_files(root: str, suffix: str = "") -> list[str]:
    """The files of a snapshot: root itself, or root.0, root.1 and so on. FileNotFoundError if there is neither."""
    if is_file(root + suffix):
        return [root + suffix]
    files, i = [], 0
    while is_file(f"{root}.{i}{suffix}"):
        files.append(f"{root}.{i}{suffix}")
        i += 1
    if not files:
        raise FileNotFoundError(f"no snapshot at {root}{suffix} or {root}.0{suffix}")
    return files
