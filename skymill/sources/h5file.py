"""Reading HDF5 files in plain Python: groups, attributes and datasets, as far as snapshots use them.

Written from the published file format. Old-style groups (symbol tables) and new-style ones (links in the header, or many
in a fractal heap), attributes likewise, numbers and fixed strings, datasets that are compact, contiguous or chunked by a
B-tree, a single chunk, an implicit or a fixed array, with the deflate, shuffle and checksum filters. What is not covered
is named in a ValueError. Only what is asked for is read: headers on opening, and of datasets the rows wanted.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from .files import open_file

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Numbers of the messages that an object's header holds.
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE, ATTRIBUTE_INFO = 0x1, 0x2, 0x3, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x15
#: Numbers of the filters.
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


def _number(data: bytes) -> int:
    return int.from_bytes(data, "little")


def _up8(n: int) -> int:
    return n + 7 & ~7


class Cursor:
    """Fields of a byte string, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the HDF5 file is cut off")
        self.at += n
        return out

    def number(self, n: int) -> int:
        return _number(self.take(n))


class H5File:
    """with H5File(path) as f: f["Header"].attrs, f["PartType0/Coordinates"].rows(0, 10)."""

    def __init__(self, path: str):
        self.file = open_file(path)
        self.size = self.file.size()
        at = 0
        while self.at(at, 8) != SIGNATURE:
            at = at * 2 or 512
            if at >= self.size:
                raise ValueError(f"{path} is no HDF5 file")
        head = Cursor(self.at(at, 128), 8)
        version = head.number(1)
        if version < 2:
            head.take(4)
            self.offset, self.length = head.number(1), head.number(1)
            head.take(9 + (4 if version == 1 else 0))
            self.base = head.number(self.offset)
            head.take(3 * self.offset + self.offset)
            root = head.number(self.offset)
        else:
            self.offset, self.length, _ = head.number(1), head.number(1), head.number(1)
            self.base = head.number(self.offset)
            head.take(2 * self.offset)
            root = head.number(self.offset)
        self.none = (1 << 8 * self.offset) - 1
        self.root = Node(self, root)

    def __enter__(self) -> H5File:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, place: int, n: int) -> bytes:
        return self.file.read_at(n, place)

    def block(self, address: int, n: int) -> bytes:
        """n bytes at an address; fewer at the end of the file."""
        return self.at(self.base + address, n)

    def __getitem__(self, name: str) -> Node:
        node = self.root
        for part in name.strip("/").split("/"):
            node = node.child(part)
        return node

    def __contains__(self, name: str) -> bool:
        try:
            self[name]
        except KeyError:
            return False
        return True


@dataclass
class Layout:
    """Where a dataset's bytes are. kind: compact, contiguous or chunked; index: how chunks are found."""

    kind: str
    address: int = 0
    data: bytes = b""
    chunk: tuple[int, ...] = ()
    index: str = ""
    extra: dict = field(default_factory=dict)


class Node:
    """An object of the file, a group or a dataset."""

    def __init__(self, file: H5File, address: int):
        self.file, self.address = file, address

    @cached_property
    def messages(self) -> list[tuple[int, int, bytes]]:
        """(type, flags, body) of every header message."""
        return list(self._new_messages() if self.file.block(self.address, 4) == b"OHDR" else self._old_messages())

    def _old_messages(self) -> Iterator[tuple[int, int, bytes]]:
        head = Cursor(self.file.block(self.address, 16))
        if head.number(1) != 1:
            raise ValueError("unknown version of an HDF5 object header")
        head.take(1)
        count = head.number(2)
        head.take(4)
        blocks = [(self.address + 16, head.number(4))]
        while blocks and count > 0:
            at, size = blocks.pop(0)
            c = Cursor(self.file.block(at, size))
            while c.at + 8 <= size and count > 0:
                kind, n, flags = c.number(2), c.number(2), c.number(1)
                c.take(3)
                body = c.take(n)
                count -= 1
                if kind == CONTINUATION:
                    blocks.append((_number(body[: self.file.offset]), _number(body[self.file.offset : self.file.offset + self.file.length])))
                else:
                    yield kind, flags, body

    def _new_messages(self) -> Iterator[tuple[int, int, bytes]]:
        head = Cursor(self.file.block(self.address, 64), 5)
        flags = head.number(1)
        head.take((16 if flags & 32 else 0) + (4 if flags & 16 else 0))
        size = head.number(1 << (flags & 3))
        blocks = [(self.address + head.at, size)]
        order = 2 if flags & 4 else 0
        while blocks:
            at, size = blocks.pop(0)
            c = Cursor(self.file.block(at, size))
            # What is too short for a message is a gap.
            while c.at + 4 + order <= size:
                kind, n, marks = c.number(1), c.number(2), c.number(1)
                c.take(order)
                body = c.take(n)
                if kind == CONTINUATION:
                    place, n = _number(body[: self.file.offset]), _number(body[self.file.offset : self.file.offset + self.file.length])
                    if self.file.block(place, 4) != b"OCHK":
                        raise ValueError("damaged continuation of an HDF5 object header")
                    blocks.append((place + 4, n - 8))
                else:
                    yield kind, marks, body

    def _body(self, kind: int) -> bytes | None:
        for k, flags, body in self.messages:
            if k == kind:
                if flags & 2:
                    raise ValueError("shared HDF5 messages are not read")
                return body
        return None

    # Groups

    @cached_property
    def links(self) -> dict[str, int]:
        """Names and addresses of a group's members; links to other files or by name are left out."""
        out: dict[str, int] = {}
        if table := self._body(SYMBOL_TABLE):
            c = Cursor(table)
            tree, heap = c.number(self.file.offset), c.number(self.file.offset)
            names = self._local_heap(heap)
            out |= {names[a : names.index(b"\0", a)].decode(): place for a, place in self._symbols(tree)}
        for kind, _, body in self.messages:
            if kind == LINK:
                self._add_link(body, out)
        if info := self._body(LINK_INFO):
            c = Cursor(info, 1)
            if c.number(1) & 1:
                c.take(8)
            heap, tree = c.number(self.file.offset), c.number(self.file.offset)
            if heap != self.file.none:
                store = Heap(self.file, heap)
                for record in store_records(self.file, tree):
                    self._add_link(store.get(record[4:]), out)
        return out

    def child(self, name: str) -> Node:
        return Node(self.file, self.links[name])

    def __contains__(self, name: str) -> bool:
        return name in self.links

    def __getitem__(self, name: str) -> Node:
        return self.child(name)

    def _add_link(self, body: bytes, out: dict[str, int]) -> None:
        c = Cursor(body, 1)
        flags = c.number(1)
        kind = c.number(1) if flags & 8 else 0
        c.take((8 if flags & 4 else 0) + (1 if flags & 16 else 0))
        name = c.take(c.number(1 << (flags & 3))).decode()
        if kind == 0:
            out[name] = c.number(self.file.offset)

    def _local_heap(self, address: int) -> bytes:
        c = Cursor(self.file.block(address, 8 + 2 * self.file.length + self.file.offset))
        if c.take(4) != b"HEAP":
            raise ValueError("damaged HDF5 heap")
        c.take(4)
        size = c.number(self.file.length)
        c.take(self.file.length)
        return self.file.block(c.number(self.file.offset), size)

    def _symbols(self, address: int) -> Iterator[tuple[int, int]]:
        """(place of the name in the heap, address) of a group's members."""
        o, n = self.file.offset, self.file.length
        start = self.file.block(address, 8)
        if start[:4] == b"SNOD":
            c = Cursor(self.file.block(address + 8, _number(start[6:8]) * (2 * o + 24)))
            for _ in range(_number(start[6:8])):
                name, place = c.number(o), c.number(o)
                c.take(24)
                yield name, place
            return
        if start[:4] != b"TREE":
            raise ValueError("damaged HDF5 group")
        used = _number(start[6:8])
        c = Cursor(self.file.block(address + 8 + 2 * o, used * (n + o) + n))
        for _ in range(used):
            c.take(n)
            yield from self._symbols(c.number(o))

    # Attributes

    @cached_property
    def attrs(self) -> dict[str, np.ndarray]:
        """Numbers and fixed strings by name; attributes of other types are left out."""
        bodies = [body for kind, _, body in self.messages if kind == ATTRIBUTE]
        if info := self._body(ATTRIBUTE_INFO):
            c = Cursor(info, 1)
            if c.number(1) & 1:
                c.take(2)
            heap, tree = c.number(self.file.offset), c.number(self.file.offset)
            if heap != self.file.none:
                store = Heap(self.file, heap)
                bodies += [store.get(record[:8]) for record in store_records(self.file, tree)]
        out = {}
        for body in bodies:
            c = Cursor(body)
            version, flags = c.number(1), c.number(1)
            sizes = [c.number(2) for _ in range(3)]
            c.take(1 if version == 3 else 0)
            name, kind, space = (c.take(_up8(n) if version == 1 else n)[:n] for n in sizes)
            if version > 1 and flags & 3:
                continue
            try:
                dtype = _dtype(kind)
            except ValueError:
                continue
            shape = self._shape(space)
            count = int(np.prod(shape, dtype=np.int64))
            out[name.split(b"\0")[0].decode()] = np.frombuffer(c.take(count * dtype.itemsize), dtype).reshape(shape)
        return out

    # Datasets

    def _shape(self, body: bytes) -> tuple[int, ...]:
        c = Cursor(body)
        version, rank = c.number(1), c.number(1)
        c.take(6 if version == 1 else 2)
        return tuple(c.number(self.file.length) for _ in range(rank))

    @cached_property
    def shape(self) -> tuple[int, ...]:
        space = self._body(DATASPACE)
        if space is None:
            raise ValueError("the HDF5 object is no dataset")
        return self._shape(space)

    @cached_property
    def dtype(self) -> np.dtype:
        return _dtype(self._body(DATATYPE))

    @cached_property
    def filters(self) -> list[tuple[int, list[int]]]:
        body = self._body(FILTERS)
        if body is None:
            return []
        c = Cursor(body)
        version, count = c.number(1), c.number(1)
        c.take(6 if version == 1 else 0)
        out = []
        for _ in range(count):
            kind = c.number(2)
            name = c.number(2) if version == 1 or kind >= 256 else 0
            c.take(2)
            values = c.number(2)
            c.take(_up8(name) if version == 1 else name)
            out.append((kind, [c.number(4) for _ in range(values)]))
            if version == 1 and values % 2:
                c.take(4)
        if strange := [k for k, _ in out if k not in (DEFLATE, SHUFFLE, CHECKSUM)]:
            raise ValueError(f"HDF5 filters {strange} are not read")
        return out

    @cached_property
    def layout(self) -> Layout:
        c, o, n = Cursor(self._body(LAYOUT)), self.file.offset, self.file.length
        version = c.number(1)
        if version not in (3, 4):
            raise ValueError(f"version {version} of an HDF5 data layout is not read")
        kind = c.number(1)
        if kind == 0:
            return Layout("compact", data=c.take(c.number(2)))
        if kind == 1:
            return Layout("contiguous", c.number(o))
        if kind != 2:
            raise ValueError("virtual HDF5 datasets are not read")
        if version == 3:
            rank = c.number(1)
            address = c.number(o)
            return Layout("chunked", address, chunk=tuple(c.number(4) for _ in range(rank))[:-1], index="tree")
        flags, rank, width = c.number(1), c.number(1), c.number(1)
        chunk = tuple(c.number(width) for _ in range(rank))[:-1]
        index, extra = c.number(1), {}
        if index == 1:
            if flags & 2:
                extra = {"size": c.number(n), "mask": c.number(4)}
        elif index == 3:
            extra = {"page_bits": c.number(1)}
        elif index != 2:
            raise ValueError(f"HDF5 chunk index {index} is not read")
        return Layout("chunked", c.number(o), chunk=chunk, index={1: "single", 2: "implicit", 3: "fixed"}[index], extra=extra)

    def rows(self, low: int, high: int) -> np.ndarray:
        """Rows low to high - 1 along the first axis; only their bytes, or the chunks that hold them, are read."""
        high = min(high, self.shape[0])
        low = min(low, high)
        shape = (high - low, *self.shape[1:])
        width = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize
        if self.layout.kind == "compact":
            return np.frombuffer(self.layout.data[low * width : high * width], self.dtype).reshape(shape)
        if self.layout.address == self.file.none:
            return np.zeros(shape, self.dtype)
        if self.layout.kind == "contiguous":
            data = self.file.block(self.layout.address + low * width, (high - low) * width)
            if len(data) < (high - low) * width:
                raise ValueError("the HDF5 file is cut off")
            return np.frombuffer(data, self.dtype).reshape(shape)
        out = np.zeros(shape, self.dtype)
        for offsets, address, size, mask in self._chunks(low, high):
            part = self._unpacked(self.file.block(address, size), mask)
            a, b = max(low, offsets[0]), min(high, offsets[0] + self.layout.chunk[0])
            rest = tuple(slice(at, min(at + c, s)) for at, c, s in zip(offsets[1:], self.layout.chunk[1:], self.shape[1:], strict=True))
            inner = tuple(slice(0, s.stop - s.start) for s in rest)
            out[(slice(a - low, b - low), *rest)] = part[(slice(a - offsets[0], b - offsets[0]), *inner)]
        return out

    def _unpacked(self, data: bytes, mask: int) -> np.ndarray:
        """A chunk's values; filters are undone from the last to the first, but for those that the mask leaves out."""
        for i in range(len(self.filters) - 1, -1, -1):
            kind, values = self.filters[i]
            if mask >> i & 1:
                continue
            if kind == DEFLATE:
                data = zlib.decompress(data)
            elif kind == CHECKSUM:
                data = data[:-4]
            else:
                width = values[0] if values else self.dtype.itemsize
                n = len(data) // width
                data = np.frombuffer(data[: n * width], np.uint8).reshape(width, n).T.tobytes() + data[n * width :]
        count = int(np.prod(self.layout.chunk, dtype=np.int64))
        return np.frombuffer(data, self.dtype, count).reshape(self.layout.chunk)

    def _chunks(self, low: int, high: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, bytes, filter mask) of the chunks that hold rows low to high - 1."""
        layout, o = self.layout, self.file.offset
        full = int(np.prod(layout.chunk, dtype=np.int64)) * self.dtype.itemsize
        if layout.index == "tree":
            yield from (c for c in self._tree_chunks(layout.address, low, high) if c[0][0] < high and c[0][0] + layout.chunk[0] > low)
            return
        if layout.index == "single":
            yield (0,) * len(self.shape), layout.address, layout.extra.get("size", full), layout.extra.get("mask", 0)
            return
        # Chunks are numbered along the last axis first.
        counts = [-(-s // c) for s, c in zip(self.shape, layout.chunk, strict=True)]
        across = int(np.prod(counts[1:], dtype=np.int64))
        numbers = range(low // layout.chunk[0] * across, -(-high // layout.chunk[0]) * across)
        entries = None if layout.index == "implicit" else self._fixed_array(numbers, full)
        for k in numbers:
            place = tuple(int(i) * c for i, c in zip(np.unravel_index(k, counts), layout.chunk, strict=True))
            if entries is None:
                yield place, layout.address + k * full, full, 0
            elif entries[k][0] != (1 << 8 * o) - 1:
                yield place, *entries[k]

    def _tree_chunks(self, address: int, low: int, high: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        o, rank = self.file.offset, len(self.shape) + 1
        head = self.file.block(address, 8)
        if head[:5] != b"TREE\x01":
            raise ValueError("damaged HDF5 chunk index")
        level, used = head[5], _number(head[6:8])
        c = Cursor(self.file.block(address + 8 + 2 * o, used * (8 + 8 * rank + o) + 8 + 8 * rank))
        keys, children = [], []
        for i in range(used + 1):
            size, mask = c.number(4), c.number(4)
            keys.append((tuple(c.number(8) for _ in range(rank))[:-1], size, mask))
            if i < used:
                children.append(c.number(o))
        for (place, size, mask), child, after in zip(keys, children, keys[1:], strict=False):
            if level == 0:
                yield place, child, size, mask
            elif place[0] < high and after[0][0] + self.layout.chunk[0] > low:
                yield from self._tree_chunks(child, low, high)

    def _fixed_array(self, numbers: range, full: int) -> dict[int, tuple[int, int, int]]:
        """Address, bytes and filter mask of chunks by number."""
        o, n = self.file.offset, self.file.length
        c = Cursor(self.file.block(self.layout.address, 12 + n + o))
        if c.take(4) != b"FAHD":
            raise ValueError("damaged HDF5 fixed array")
        _, client, width, bits = (c.number(1) for _ in range(4))
        count, block = c.number(n), c.number(o)
        per_page = 1 << bits
        head = 6 + o
        pages = -(-count // per_page) if count > per_page else 0
        if pages:
            head += -(-pages // 8) + 4
        out = {}
        for k in numbers:
            at = head + k * width + (k // per_page * 4 if pages else 0)
            e = Cursor(self.file.block(block + at, width))
            address = e.number(o)
            out[k] = (address, e.number(width - o - 4), e.number(4)) if client == 1 else (address, full, 0)
        return out


def _dtype(body: bytes) -> np.dtype:
    """The numpy type of numbers and fixed strings."""
    kind, bits, size = body[0] & 15, _number(body[1:4]), _number(body[4:8])
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1 and size in (2, 4, 8) and not bits & 64:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    raise ValueError(f"HDF5 datatype class {kind} is not read")


def store_records(file: H5File, address: int) -> Iterator[bytes]:
    """The records of a version 2 B-tree, in order."""
    o, n = file.offset, file.length
    c = Cursor(file.block(address, 22 + o + n))
    if c.take(4) != b"BTHD":
        raise ValueError("damaged HDF5 B-tree")
    c.take(2)
    node, width, depth = c.number(4), c.number(2), c.number(2)
    c.take(2)
    root, used = c.number(o), c.number(2)
    # Records that fit a node of each depth, and the bytes that count them: of the child alone, and with all below it.
    most, total, sizes = [(node - 10) // width], [(node - 10) // width], [(0, 0)]
    own = (most[0].bit_length() + 7) // 8
    for d in range(1, depth + 1):
        below = (total[-1].bit_length() + 7) // 8 if d > 1 else 0
        sizes.append((own, below))
        pointer = o + own + below
        most.append((node - 10 - pointer) // (width + pointer))
        total.append((most[-1] + 1) * total[-1] + most[-1])

    def walk(at: int, count: int, d: int) -> Iterator[bytes]:
        body = Cursor(file.block(at, node), 6)
        records = [body.take(width) for _ in range(count)]
        if d == 0:
            yield from records
            return
        own, below = sizes[d]
        for i in range(count + 1):
            child, held = body.number(o), body.number(own)
            body.take(below)
            yield from walk(child, held, d - 1)
            if i < count:
                yield records[i]

    if used:
        yield from walk(root, used, depth)


class Heap:
    """A fractal heap: objects by id, in blocks whose sizes double from row to row."""

    def __init__(self, file: H5File, address: int):
        self.file = file
        o, n = file.offset, file.length
        c = Cursor(file.block(address, 64 + 12 * n + 3 * o))
        if c.take(4) != b"FRHP":
            raise ValueError("damaged HDF5 heap")
        c.take(1)
        self.id_width, filters = c.number(2), c.number(2)
        flags, self.largest = c.number(1), c.number(4)
        if filters:
            raise ValueError("HDF5 heaps with filters are not read")
        c.take(n + o + n + o + 8 * n)
        self.width, self.first, self.most = c.number(2), c.number(n), c.number(n)
        self.bits = c.number(2)
        c.take(2)
        self.root, self.rows = c.number(o), c.number(2)
        self.offset_bytes = (self.bits + 7) // 8
        self.head = 5 + o + self.offset_bytes + (4 if flags & 2 else 0)

    def get(self, key: bytes) -> bytes:
        c = Cursor(key[: self.id_width])
        kind = c.number(1) >> 4 & 3
        if kind == 2:
            return c.take((key[0] & 15) + 1)
        if kind:
            raise ValueError("huge HDF5 heap objects are not read")
        least = min(self.largest, self.most)
        place, size = c.number(self.offset_bytes), c.number((least.bit_length() + 7) // 8)
        return self._read(self.root, self.rows, place, size)

    def _size(self, row: int) -> int:
        """Bytes of a block in a row: the first two rows are alike, then they double."""
        return self.first << max(0, row - 1)

    def _read(self, address: int, rows: int, place: int, size: int) -> bytes:
        if not rows:
            # Offsets count a block's own head as well.
            return self.file.block(address + place, size)
        at = address + 5 + self.file.offset + self.offset_bytes
        direct = (self.most // self.first).bit_length() + 1
        for row in range(rows):
            block = self._size(row)
            if place < block * self.width:
                column, inside = divmod(place, block)
                entry = at + (row * self.width + column) * self.file.offset
                child = _number(self.file.block(entry, self.file.offset))
                below = 0 if row < direct else (block // (self.first * self.width)).bit_length()
                return self._read(child, below, inside, size)
            place -= block * self.width
        raise ValueError("damaged HDF5 heap")
