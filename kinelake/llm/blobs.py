"""Arrays sent between numbered nodes: rows (node, kind, src, data), handled one node at a time.

A node is a share of the words or pairs, or a batch of texts. Arrays travel packed, so a
row carries thousands of entries and the JVM only moves bytes.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa

SCHEMA = "node long, kind int, src long, data binary"
_HEAD = "<2sQQ"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: byte planes (the first bytes of all numbers, then the second ...), zstd."""
    out = []
    for a in arrays:
        code = a.dtype.str[1:].encode()
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        data = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out += [struct.pack(_HEAD, code, len(a), len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    view = memoryview(data)
    while at < len(view):
        code, n, size = struct.unpack_from(_HEAD, view, at)
        at += struct.calcsize(_HEAD)
        kind = np.dtype("<" + code.decode())
        if n:
            planes = np.frombuffer(pa.decompress(view[at : at + size], decompressed_size=n * kind.itemsize, codec="zstd"), np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        else:
            out.append(np.zeros(0, kind))
        at += size
    return out


class Rows:
    """Rows that a step gives."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, bytes]] = []

    def add(self, node: int, kind: int, src: int, *arrays: np.ndarray) -> None:
        self.rows.append((int(node), kind, int(src), pack(*arrays)))

    def deal(self, node: np.ndarray, nodes: int, kind: int, src: int, *arrays: np.ndarray) -> None:
        """A row for each node that has entries; arrays are sorted by node."""
        edge = np.searchsorted(node, np.arange(nodes + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            self.add(k, kind, src, *(a[edge[k] : edge[k + 1]] for a in arrays))

    def table(self) -> pa.Table:
        columns = zip(*self.rows, strict=True) if self.rows else ((), (), (), ())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        pa.default_memory_pool().release_unused()  # the worker process stays for other tasks
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "kind", "src", "data"])


def received(table: pa.Table) -> dict[int, list[tuple[int, list[np.ndarray]]]]:
    """What a node got, by kind: (src, arrays), by src."""
    out = defaultdict(list)
    for kind, src, data in zip(*(table[c].to_pylist() for c in ("kind", "src", "data")), strict=True):
        if data is not None:
            out[kind].append((src, data))
    return defaultdict(list, {k: [(src, unpack(data)) for src, data in sorted(v)] for k, v in out.items()})


def joined(parts: list[tuple[int, list[np.ndarray]]], k: int, kind) -> np.ndarray:
    """Array k of all parts, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(a[k] for _, a in parts)]).astype(kind, copy=False)
