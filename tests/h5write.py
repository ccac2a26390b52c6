"""HDF5 files for tests, written byte by byte: old and new styles of every structure that snapshots use."""

import struct
import zlib

import numpy as np

O = 8
NONE = b"\xff" * 8


def up8(data):
    return data + b"\0" * (-len(data) % 8)


def dtype_body(dtype):
    dtype = np.dtype(dtype)
    n = dtype.itemsize
    big = dtype.byteorder == ">"
    if dtype.kind in "iu":
        return struct.pack("<B3BI2H", 0x10, big | (8 if dtype.kind == "i" else 0), 0, 0, n, 0, 8 * n)
    if dtype.kind == "f":
        exponent, mantissa = {2: (5, 10), 4: (8, 23), 8: (11, 52)}[n]
        return struct.pack("<B3BI2H4BI", 0x11, 0x20 | big, 8 * n - 1, 0, n, 0, 8 * n, mantissa, exponent, 0, mantissa, (1 << exponent - 1) - 1)
    return struct.pack("<B3BI", 0x13, 0, 0, 0, n)


def space_body(shape, version=1):
    head = struct.pack("<BBBB4x", 1, len(shape), 0, 0) if version == 1 else struct.pack("<4B", 2, len(shape), 0, 1 if shape else 0)
    return head + b"".join(struct.pack("<Q", s) for s in shape)


def attribute_body(name, value, version):
    value = np.asarray(value)
    parts = [name.encode() + b"\0", dtype_body(value.dtype), space_body(value.shape, 1 if version == 1 else 2)]
    head = struct.pack("<BB3H", version, 0, *map(len, parts)) + (b"\0" if version == 3 else b"")
    return head + b"".join(map(up8, parts) if version == 1 else parts) + value.tobytes()


def shuffled(data, width):
    n = len(data) // width
    return np.frombuffer(data[: n * width], np.uint8).reshape(n, width).T.tobytes() + data[n * width :]


class Writer:
    """new: superblock 2, version 2 headers, links in headers; dense: many links and attributes in a fractal heap."""

    def __init__(self, new=False, dense=False):
        self.out, self.new, self.dense = bytearray(96), new, dense

    def put(self, data):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def header(self, messages, split=False):
        """An object header; split: its later messages in a continuation block."""
        if self.new:
            def packed(some):
                return b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in some)

            first, rest = (messages[:1], messages[1:]) if split and len(messages) > 1 else (messages, [])
            if rest:
                body = b"OCHK" + packed(rest) + b"\0\0" + b"sum!"
                place = self.put(body)
                first = [*first, (0x10, struct.pack("<QQ", place, len(body)))]
            body = packed(first)
            return self.put(b"OHDR" + struct.pack("<BB", 2, 2 | 32) + b"time" * 4 + struct.pack("<I", len(body)) + body + b"sum!")

        def packed(some):
            return b"".join(struct.pack("<HHB3x", k, len(up8(b)), 0) + up8(b) for k, b in some)

        first, rest = (messages[:1], messages[1:]) if split and len(messages) > 1 else (messages, [])
        count = len(messages) + bool(rest)
        if rest:
            body = packed(rest)
            first = [*first, (0x10, struct.pack("<QQ", self.put(body), len(body)))]
        body = packed(first)
        return self.put(struct.pack("<BBHII4x", 1, 0, count, 1, len(body)) + body)

    def heap(self, objects, kind, record):
        """(heap, tree): objects of a fractal heap in two rows of direct blocks, and a B-tree of two levels over their ids."""
        first, most = 512, 4096
        head, ids = 5 + O + 4, []
        blocks, block = [], bytearray(head)
        for data in objects:
            size = first << max(0, len(blocks) // 4 - 1)
            if len(block) + len(data) > size:
                blocks.append(bytes(block.ljust(size, b"\0")))
                block = bytearray(head)
            start = sum(map(len, blocks)) + len(block)
            ids.append(bytes([0]) + start.to_bytes(4, "little") + len(data).to_bytes(2, "little"))
            block += data
        blocks.append(bytes(block.ljust(first << max(0, len(blocks) // 4 - 1), b"\0")))
        places = [self.put(b) for b in blocks]
        rows = -(-len(blocks) // 4)
        entries = b"".join(struct.pack("<Q", p) for p in places) + NONE * (4 * rows - len(places))
        root = self.put(b"FHIB" + b"\0" + b"\0" * O + b"\0" * 4 + entries + b"sum!")
        self_head = b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, most) + b"\0" * 8 + NONE + b"\0" * 8 + NONE + b"\0" * 64
        heap = self.put(self_head + struct.pack("<HQQHHQH", 4, first, most, 32, 1, root, rows) + b"sum!")
        records = sorted(record(i) for i in ids)
        width = len(records[0])
        node = 512
        per = (node - 10) // width
        leaves, between = [], []
        while records:
            leaves.append(records[: per - 1])
            records = records[per - 1 :]
            if records:
                between.append(records.pop(0))
                if not records:
                    leaves.append([])
        addresses = [self.put((b"BTLF" + struct.pack("<BB", 0, kind) + b"".join(x)).ljust(node, b"\0")) for x in leaves]
        if len(leaves) == 1:
            depth, root, used = 0, addresses[0], len(leaves[0])
        else:
            pointers = b"".join(struct.pack("<QB", a, len(x)) for a, x in zip(addresses, leaves, strict=True))
            depth, used = 1, len(between)
            root = self.put((b"BTIN" + struct.pack("<BB", 0, kind) + b"".join(between) + pointers).ljust(node, b"\0"))
        tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, kind, node, width, depth, 98, 40, root, used, len(ids)) + b"sum!")
        return heap, tree

    def attributes(self, attrs):
        if self.new and self.dense and len(attrs) > 4:
            heap, tree = self.heap([attribute_body(k, v, 3) for k, v in attrs.items()], 8, lambda i: i.ljust(8, b"\0") + b"\0" * 5 + i[1:5])
            return [(0x15, struct.pack("<BBQQ", 0, 0, heap, tree))]
        return [(0xC, attribute_body(k, v, 1 if not self.new else 2 + i % 2)) for i, (k, v) in enumerate(attrs.items())]

    def group(self, members, attrs=None, split=False):
        attrs = self.attributes(attrs or {})
        if self.new:
            links = [struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", a) for n, a in members.items()]
            if self.dense and len(links) > 4:
                heap, tree = self.heap(links, 5, lambda i: i[1:5] + i)
                return self.header([(0x2, struct.pack("<BBQQ", 0, 0, heap, tree)), *attrs], split)
            return self.header([(0x2, struct.pack("<BB", 0, 0) + NONE + NONE), *[(0x6, x) for x in links], *attrs], split)
        heap, places = bytearray(8), {}
        for n in sorted(members):
            places[n] = len(heap)
            heap += up8(n.encode() + b"\0")
        data = self.put(bytes(heap))
        heap_at = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, data))
        names = sorted(members)
        nodes = [names[i : i + 3] for i in range(0, len(names), 3)]
        leaves = [self.put((b"SNOD" + struct.pack("<BBH", 1, 0, len(x)) + b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in x)).ljust(8 + 8 * 40, b"\0")) for x in nodes]
        body = b"".join(struct.pack("<QQ", places[x[0]], a) for x, a in zip(nodes, leaves, strict=True)) + struct.pack("<Q", places[names[-1]] if names else 0)
        tree = self.put(b"TREE" + struct.pack("<BBH", 0, 0, len(nodes)) + NONE + NONE + body)
        return self.header([(0x11, struct.pack("<QQ", tree, heap_at)), *attrs], split)

    def dataset(self, values, chunk=None, packed=(), index="tree", missing=()):
        """packed: filters of deflate, shuffle and checksum; missing: numbers of chunks that were never written."""
        values = np.asarray(values)
        messages = [(0x1, space_body(values.shape, 2 if self.new else 1)), (0x3, dtype_body(values.dtype))]
        width = values.dtype.itemsize
        numbers = {"shuffle": (2, [width]), "deflate": (1, [6]), "checksum": (3, [])}
        if packed:
            some = [numbers[k] for k in packed]
            if self.new:
                messages.append((0xB, struct.pack("<BB", 2, len(some)) + b"".join(struct.pack("<3H", n, 0, len(v)) + struct.pack(f"<{len(v)}I", *v) for n, v in some)))
            else:
                messages.append((0xB, struct.pack("<BB6x", 1, len(some)) + b"".join(struct.pack("<4H", n, 8, 0, len(v)) + b"name\0\0\0\0" + struct.pack(f"<{len(v)}I", *v) + b"\0" * (4 * (len(v) % 2)) for n, v in some)))
        if chunk is None:
            if values.nbytes < 64 and self.new:
                layout = struct.pack("<BBH", 3, 0, values.nbytes) + values.tobytes()
            else:
                layout = struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()) if values.size else 2**64 - 1, values.nbytes)
            return self.header([*messages, (0x8, layout)])
        counts = [-(-s // c) for s, c in zip(values.shape, chunk, strict=True)]
        stored = []
        for k, place in enumerate(np.ndindex(*counts)):
            full = np.zeros(chunk, values.dtype)
            part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(place, chunk, strict=True))]
            full[tuple(map(slice, part.shape))] = part
            data = full.tobytes()
            for f in packed:
                data = shuffled(data, width) if f == "shuffle" else zlib.compress(data) if f == "deflate" else data + b"sum!"
            offsets = [i * c for i, c in zip(place, chunk, strict=True)]
            stored.append((offsets, data, k))
        if index == "tree":
            kept = [(o, self.put(d), len(d)) for o, d, k in stored if k not in missing]

            def key(offsets, size):
                return struct.pack("<II", size, 0) + b"".join(struct.pack("<Q", o) for o in [*offsets, 0])

            end = key([counts[0] * chunk[0], *[0] * (len(chunk) - 1)], 0)
            nodes = [kept[i : i + 4] for i in range(0, len(kept), 4)]
            leaves = []
            for i, x in enumerate(nodes):
                last = key(*[(nodes[i + 1][0][0], nodes[i + 1][0][2])][0]) if i + 1 < len(nodes) else end
                leaves.append(self.put(b"TREE" + struct.pack("<BBH", 1, 0, len(x)) + NONE + NONE + b"".join(key(o, n) + struct.pack("<Q", a) for o, a, n in x) + last))
            root = leaves[0] if len(leaves) == 1 else self.put(b"TREE" + struct.pack("<BBH", 1, 1, len(leaves)) + NONE + NONE + b"".join(key(x[0][0], x[0][2]) + struct.pack("<Q", a) for x, a in zip(nodes, leaves, strict=True)) + end)
            layout = struct.pack("<BBBQ", 3, 2, len(chunk) + 1, root) + b"".join(struct.pack("<I", c) for c in [*chunk, width])
            return self.header([*messages, (0x8, layout)])
        dims = b"".join(struct.pack("<I", c) for c in [*chunk, width])
        if index == "single":
            data = stored[0][1]
            tail = struct.pack("<BQIQ", 1, len(data), 0, self.put(data)) if packed else struct.pack("<BQ", 1, self.put(data))
            return self.header([*messages, (0x8, struct.pack("<BBBBB", 4, 2, 2 if packed else 0, len(chunk) + 1, 4) + dims + tail)])
        if index == "implicit":
            return self.header([*messages, (0x8, struct.pack("<BBBBB", 4, 2, 0, len(chunk) + 1, 4) + dims + struct.pack("<BQ", 2, self.put(b"".join(d for _, d, _ in stored))))])
        bits = 3  # pages of 8 entries
        entries = [b"\xff" * (8 + (8 if packed else 0)) if k in missing else struct.pack("<Q", self.put(d)) + (struct.pack("<II", len(d), 0) if packed else b"") for _, d, k in stored]
        header = len(self.out) + (-len(self.out) % 8)
        width_e = len(entries[0])
        block = b"FADB" + struct.pack("<BBQ", 0, bool(packed), header)
        if len(entries) > 1 << bits:
            pages = [entries[i : i + 8] for i in range(0, len(entries), 8)]
            block += b"\xff" * (-(-len(pages) // 8)) + b"sum!" + b"".join(b"".join(p) + b"sum!" for p in pages)
        else:
            block += b"".join(entries) + b"sum!"
        place = header + 32
        assert self.put((b"FAHD" + struct.pack("<BBBBQQ", 0, bool(packed), width_e, bits, len(entries), place) + b"sum!").ljust(32, b"\0")) == header
        assert self.put(block) == place
        return self.header([*messages, (0x8, struct.pack("<BBBBB", 4, 2, 0, len(chunk) + 1, 4) + dims + struct.pack("<BBQ", 3, bits, header))])

    def save(self, path, root, shift=0):
        """shift: bytes before the superblock."""
        sign = b"\x89HDF\r\n\x1a\n"
        if self.new:
            head = sign + struct.pack("<4BQQQQ", 2, 8, 8, 0, shift, 2**64 - 1, len(self.out), root) + b"sum!"
        else:
            head = sign + struct.pack("<8BHHIQQQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, shift, 2**64 - 1, len(self.out), 2**64 - 1, 0, root)
        assert len(head) <= 96
        self.out[: len(head)] = head
        with open(path, "wb") as f:
            f.write(b"\0" * shift + bytes(self.out))
