"""Small netCDF-4 files for tests, written after the public format specification."""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np

NOWHERE = b"\xff" * 8


class Writer:
    """``old``: superblock 0, version 1 headers, a symbol table; else superblock 2 and version 2 headers.

    ``dense``: links (or attributes beyond eight) go to a fractal heap with a version 2 tree.
    """

    def __init__(self, old: bool = False, dense: bool = False, indirect: bool = False):
        self.old, self.dense, self.indirect = old, dense, indirect
        self.data = bytearray(b"\0" * 96)

    def put(self, raw: bytes) -> int:
        self.data += b"\0" * (-len(self.data) % 8)
        self.data += raw
        return len(self.data) - len(raw)

    @staticmethod
    def kind(dtype: np.dtype) -> bytes:
        dtype = np.dtype(dtype)
        big = int(dtype.byteorder == ">")
        if dtype.kind in "iu":
            return struct.pack("<B3BI", 0x10, big | (8 if dtype.kind == "i" else 0), 0, 0, dtype.itemsize) + struct.pack("<HH", 0, 8 * dtype.itemsize)
        if dtype.kind == "f":
            bits = {4: (0, 32, 23, 8, 0, 23, 127), 8: (0, 64, 52, 11, 0, 52, 1023)}[dtype.itemsize]
            return struct.pack("<B3BI", 0x11, 0x20 | big, bits[1] - 1, 0, dtype.itemsize) + struct.pack("<HHBBBBI", *bits)
        return struct.pack("<B3BI", 0x13, 0, 0, 0, dtype.itemsize)

    def shape(self, dims: tuple[int, ...]) -> bytes:
        head = struct.pack("<BBBBI", 1, len(dims), 0, 0, 0) if self.old else struct.pack("<BBBB", 2, len(dims), 0, 1 if dims else 0)
        return head + b"".join(struct.pack("<Q", n) for n in dims)

    def attribute(self, name: str, value) -> bytes:
        if isinstance(value, str):
            raw, kind, dims = value.encode(), self.kind(np.dtype(f"S{max(len(value.encode()), 1)}")), ()
        elif isinstance(value, list):  # references, one list for each dimension
            objects = b"".join(struct.pack("<HHIQQ", i + 1, 1, 0, 8, v) for i, v in enumerate(value))
            size = 16 + len(objects) + 16
            heap = self.put(b"GCOL\x01\0\0\0" + struct.pack("<Q", size) + objects + b"\0" * 16)
            raw = b"".join(struct.pack("<IQI", 1, heap, i + 1) for i in range(len(value)))
            kind, dims = struct.pack("<B3BI", 0x19, 0, 0, 0, 16) + struct.pack("<B3BI", 0x17, 0, 0, 0, 8), (len(value),)
        else:
            value = np.asarray(value)
            raw, kind, dims = value.tobytes(), self.kind(value.dtype), value.shape
        parts = [name.encode() + b"\0", kind, self.shape(dims)]
        head = struct.pack("<BBHHH", 1 if self.old else 3, 0, *map(len, parts))
        if self.old:
            return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts) + raw
        return head + b"\0" + b"".join(parts) + raw

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        """The last messages go to a continuation block."""
        split = len(messages) - 1 if len(messages) > 2 else len(messages)
        if self.old:
            def block(ms):
                out = b""
                for kind, raw in ms:
                    raw += b"\0" * (-len(raw) % 8)
                    out += struct.pack("<HHB3x", kind, len(raw), 0) + raw
                return out

            rest = block(messages[split:])
            first = messages[:split] + ([(0x10, struct.pack("<QQ", self.put(rest), len(rest)))] if rest else [])
            body = block(first)
            count = len(first) + len(messages) - split
            return self.put(struct.pack("<BBHIIxxxx", 1, 0, count, 1, len(body)) + body)

        def block2(ms):
            return b"".join(struct.pack("<BHB", kind, len(raw), 0) + raw for kind, raw in ms)

        rest = block2(messages[split:])
        first = list(messages[:split])
        if rest:
            rest = b"OCHK" + rest + b"\0" * 4
            first.append((0x10, struct.pack("<QQ", self.put(rest), len(rest))))
        body = block2(first)
        return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4)

    def heap(self, objects: list[bytes], kind: int) -> tuple[int, int]:
        """(heap, tree) of objects: a direct block, or rows of them below an indirect one."""
        start, wide = 512 if self.indirect else 8192, 4
        head = 5 + 8 + wide
        blocks, ids = [bytearray()], []
        sizes = [start] * 8 + [2 * start] * 4  # rows of four
        for raw in objects:
            if head + len(blocks[-1]) + len(raw) > sizes[len(blocks) - 1]:
                blocks.append(bytearray())
            base = sum(sizes[: len(blocks) - 1])
            ids.append(struct.pack("<BIH", 0, base + head + len(blocks[-1]), len(raw)) + (b"\0" if kind == 8 else b""))
            blocks[-1] += raw
        where, at = [], 0
        for i, body in enumerate(blocks):
            where.append(self.put(b"FHDB\0" + struct.pack("<QI", 0, at) + bytes(body).ljust(sizes[i] - head, b"\0")))
            at += sizes[i]
        rows = 0
        root = where[0]
        if len(blocks) > 1:
            rows = -(-len(blocks) // 4)
            root = self.put(b"FHIB\0" + struct.pack("<QI", 0, 0) + b"".join(struct.pack("<Q", a) for a in where) + NOWHERE * (4 * rows - len(where)) + b"\0" * 4)
        heap = self.put(b"FRHP\0" + struct.pack("<HHBI", 8 if kind == 8 else 7, 0, 0, 4096) + struct.pack("<QQQQ", 0, 2**64 - 1, 0, 2**64 - 1) + b"\0" * 64 + struct.pack("<HQQHHQH", 4, start, 65536, 32, 1, root, rows) + b"\0" * 4)
        records = [(i + (b"\0" + struct.pack("<I", n) if kind == 8 else b"") + struct.pack("<I", 0)) if kind == 8 else struct.pack("<I", n) + i for n, i in enumerate(ids)]
        if kind == 8:
            records = [i + b"\0" + struct.pack("<II", n, 0) for n, i in enumerate(i[:8] for i in ids)]
        size = len(records[0])
        node = 512
        fit = (node - 10) // size
        if len(records) <= 4:
            depth, root_node, held = 0, self.put((b"BTLF\0" + bytes([kind]) + b"".join(records)).ljust(node, b"\0")), len(records)
        else:  # two leaves and a record between them
            mid = len(records) // 2
            assert mid <= fit
            leaves = [(self.put((b"BTLF\0" + bytes([kind]) + b"".join(part)).ljust(node, b"\0")), len(part)) for part in (records[:mid], records[mid + 1 :])]
            root_node = self.put((b"BTIN\0" + bytes([kind]) + records[mid] + b"".join(struct.pack("<QB", a, n) for a, n in leaves)).ljust(node, b"\0"))
            depth, held = 1, 1
        tree = self.put(b"BTHD\0" + bytes([kind]) + struct.pack("<IHHBBQHQ", node, size, depth, 100, 40, root_node, held, len(records)) + b"\0" * 4)
        return heap, tree

    def dataset(self, values: np.ndarray, attrs: dict, chunks: tuple[int, ...] | None = None, filters: tuple[str, ...] = (), fill=None, skip: tuple = ()) -> int:
        """``skip``: numbers of chunks that are not written."""
        messages = [(0x01, self.shape(values.shape)), (0x03, self.kind(values.dtype))]
        if fill is not None:
            raw = np.asarray(fill, values.dtype).tobytes()
            messages.append((0x05, struct.pack("<BBBBI", 2, 2, 2, 1, len(raw)) + raw))
        if chunks is None:
            raw = np.ascontiguousarray(values).tobytes()
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(raw), len(raw))))
        else:
            keys = []
            for n, corner in enumerate(itertools.product(*[range(0, s, c) for s, c in zip(values.shape, chunks)])):
                if n in skip:
                    continue
                whole = np.zeros(chunks, values.dtype)
                part = values[tuple(slice(a, a + c) for a, c in zip(corner, chunks))]
                whole[tuple(slice(0, k) for k in part.shape)] = part
                raw = whole.tobytes()
                if "shuffle" in filters:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
                if "deflate" in filters:
                    raw = zlib.compress(raw, 4)
                if "fletcher" in filters:
                    raw += b"sum!"
                keys.append((corner, self.put(raw), len(raw)))
            leaves = [keys[i : i + 3] for i in range(0, len(keys), 3)]

            def key(corner, size):
                return struct.pack("<II", size, 0) + b"".join(struct.pack("<Q", x) for x in (*corner, 0))

            def node(level, entries):
                return self.put(b"TREE" + struct.pack("<BBH", 1, level, len(entries)) + NOWHERE * 2 + b"".join(key(c, n) + struct.pack("<Q", a) for c, a, n in entries) + key(values.shape, 0))

            tops = [(leaf[0][0], node(0, leaf), leaf[0][2]) for leaf in leaves]
            messages.append((0x08, struct.pack("<BBBQ", 3, 2, len(chunks) + 1, node(1, tops)) + struct.pack(f"<{len(chunks) + 1}I", *chunks, values.dtype.itemsize)))
            steps = [(i, v) for name, i, v in (("shuffle", 2, [values.dtype.itemsize]), ("deflate", 1, [4]), ("fletcher", 3, [])) if name in filters]
            if steps and self.old:
                messages.append((0x0B, struct.pack("<BB6x", 1, len(steps)) + b"".join(struct.pack("<HHHH", i, 8, 0, len(v)) + b"filter\0\0" + b"".join(struct.pack("<I", x) for x in v) + b"\0" * (4 * (len(v) % 2)) for i, v in steps)))
            elif steps:
                messages.append((0x0B, struct.pack("<BB", 2, len(steps)) + b"".join(struct.pack("<HHH", i, 0, len(v)) + b"".join(struct.pack("<I", x) for x in v) for i, v in steps)))
        raws = [self.attribute(k, v) for k, v in attrs.items()]
        if self.dense and len(raws) > 2:
            messages.append((0x15, struct.pack("<BBQQ", 0, 0, *self.heap(raws, 8))))
        else:
            messages += [(0x0C, r) for r in raws]
        return self.header(messages)

    def save(self, path: str, members: list[tuple[str, int]]) -> None:
        if self.old:
            members = sorted(members)
            names, at = bytearray(8), {}
            for name, _ in members:
                at[name] = len(names)
                names += name.encode() + b"\0"
                names += b"\0" * (-len(names) % 8)
            heap = self.put(b"HEAP\0\0\0\0" + struct.pack("<QQQ", len(names), 1, self.put(bytes(names))))
            half = -(-len(members) // 2)
            nodes = [self.put(b"SNOD\x01\0" + struct.pack("<H", len(part)) + b"".join(struct.pack("<QQII16x", at[n], a, 0, 0) for n, a in part)) for part in (members[:half], members[half:]) if part]
            tree = self.put(b"TREE" + struct.pack("<BBH", 0, 0, len(nodes)) + NOWHERE * 2 + struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", a, 0) for a in nodes))
            root = self.header([(0x11, struct.pack("<QQ", tree, heap))])
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<Q", 0) + NOWHERE + struct.pack("<Q", len(self.data)) + NOWHERE + struct.pack("<QQII16x", 0, root, 0, 0)
        else:
            links = [struct.pack("<BBQB", 1, 4, i, len(n.encode())) + n.encode() + struct.pack("<Q", a) for i, (n, a) in enumerate(members)]
            if self.dense:
                root = self.header([(0x02, struct.pack("<BBQQ", 0, 0, *self.heap(links, 5)))])
            else:
                root = self.header([(0x06, raw) for raw in links])
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<QQQQI", 0, 2**64 - 1, len(self.data), root, 0)
        self.data[: len(head)] = head
        with open(path, "wb") as f:
            f.write(self.data)


def write_netcdf4(path: str, dims: dict[str, np.ndarray], variables: dict, time_units: str = "days since 1950-01-01 00:00", stored: tuple[str, ...] = ("time", "latitude", "longitude"), old: bool = False, dense: bool = False, indirect: bool = False, **storage) -> None:
    """Coordinates and packed variables (name: (values in stored order, attributes)) as netCDF-4 lays them out."""
    w = Writer(old, dense, indirect)
    members, at = [], {}
    for i, (d, values) in enumerate(dims.items()):
        attrs = {"CLASS": "DIMENSION_SCALE", "NAME": d, "_Netcdf4Dimid": np.int32(i)}
        if d == "time":
            attrs |= {"units": time_units, "calendar": "standard"}
        at[d] = w.dataset(values, attrs)
        members.append((d, at[d]))
    for name, (values, attrs) in variables.items():
        attrs = dict(attrs) | {"DIMENSION_LIST": [at[d] for d in stored]}
        members.append((name, w.dataset(values, attrs, **storage)))
    w.save(path, members)
