"""Loops over a graph that keep a few numbers per node.

Nodes are numbered in order of their ids; the edges into a range of nodes are one part, a file of numbers in the shared folder, and so is
each part of a node vector. A round is one job without an exchange: a task reads whole vectors (8 bytes a node) and its part of the
edges, and writes its part of the new vectors. The driver sees a few numbers a part.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import shared_dir


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])


def _put(folder: str, name: str, values: np.ndarray) -> None:
    """Written under a name of this attempt, then renamed: a retried task replaces its own."""
    fs, base = _fs(folder)
    out = io.BytesIO()
    np.save(out, values)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(out.getbuffer())
    fs.move(draft, f"{base}/{name}")


def _get(folder: str, name: str) -> np.ndarray:
    fs, base = _fs(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return np.load(io.BytesIO(f.read()))


class Vector:
    """A number per node, in files ``(from, to, name)`` of a folder; without files the same number for all, or (None) each node's own."""

    def __init__(self, folder: str, n: int, files: list[tuple[int, int, str]] | None = None, value: float | int | None = None) -> None:
        self.folder, self.n, self.files, self.value = folder, n, files, value

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n if hi is None else hi
        if self.files is None:
            return np.arange(lo, hi) if self.value is None else np.full(hi - lo, self.value)
        parts = [_get(self.folder, name)[max(lo - a, 0) : hi - a] for a, b, name in self.files if a < hi and b > lo]
        return np.concatenate(parts) if parts else np.zeros(0)

    def drop(self) -> None:
        for _, _, name in self.files or ():
            fs, base = _fs(self.folder)
            fs.delete_file(f"{base}/{name}")


class Part:
    """The edges into nodes ``lo`` to ``hi`` - 1: ``src`` in order of the target, where each target begins, and the targets."""

    def __init__(self, lo: int, hi: int, src: np.ndarray, dst: np.ndarray) -> None:
        self.lo, self.hi, self.src, self.dst = lo, hi, src, dst
        self.starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, int)
        self.heads = dst[self.starts]

    def gather(self, per_edge: np.ndarray, how: np.ufunc, empty) -> np.ndarray:
        """``how`` (add, maximum) over each node's edges, ``empty`` where it has none."""
        out = np.full(self.hi - self.lo, empty, dtype=per_edge.dtype)
        if len(self.starts):
            out[self.heads - self.lo] = how.reduceat(per_edge, self.starts)
        return out


class Nodes:
    """The nodes of ``rows`` (node, ...), each once, numbered in order; further columns, numbers, become vectors."""

    def __init__(self, rows: DataFrame, part: int = 2_000_000) -> None:
        self.spark, self.part = rows.sparkSession, part
        base = shared_dir(self.spark).rstrip("/")
        self.folder = folder = f"{base}/rounds-{uuid.uuid4().hex}"
        fs, path = _fs(folder)
        fs.create_dir(path, recursive=True)
        rows.write.parquet(f"{folder}/nodes")
        rows = self.spark.read.schema(rows.schema).parquet(f"{folder}/nodes")
        names = rows.columns

        def write(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            p, got = TaskContext.get().partitionId(), list(batches)
            for c in names:
                _put(folder, f"{c}.{p}", np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) if got else np.zeros(0))
            yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int64()), "n": pa.array([sum(b.num_rows for b in got)], pa.int64())})

        parts = max(1, -(-rows.count() // part))
        counts = sorted(map(tuple, rows.repartitionByRange(parts, "node").sortWithinPartitions("node").mapInArrow(write, "p long, n long").where("n > 0").collect()))
        ends = np.cumsum([0] + [c for _, c in counts]).tolist()
        self.n = ends[-1]
        of = lambda c: Vector(folder, self.n, [(ends[i], ends[i + 1], f"{c}.{p}") for i, (p, _) in enumerate(counts)])
        self.columns = {c: of(c) for c in names}
        self.ids = self.columns["node"]

    def full(self, value: float | int | None) -> Vector:
        return Vector(self.folder, self.n, None, value)

    def edges(self, edges: DataFrame, src: str = "src", dst: str = "dst") -> Edges:
        return Edges(self, edges, src, dst)

    def frame(self, schema: str, **vectors: Vector) -> DataFrame:
        """``node`` and a column per vector."""
        ids, n, step = self.ids, self.n, self.part
        names = ["node", *vectors]

        def rows(batches):
            import pyarrow as pa

            for b in batches:
                for i in b.column(0).to_pylist():
                    lo, hi = i * step, min(n, (i + 1) * step)
                    yield pa.RecordBatch.from_arrays([pa.array(v.read(lo, hi)) for v in (ids, *vectors.values())], names)

        parts = -(-n // step)
        return self.spark.range(0, parts, 1, max(1, parts)).mapInArrow(rows, f"node long, {schema}")


class Edges:
    """The edges into each node, in parts of about ``part`` edges. ``edges`` has each once, both ends among the nodes."""

    def __init__(self, nodes: Nodes, edges: DataFrame, src: str, dst: str) -> None:
        self.nodes, self.name = nodes, uuid.uuid4().hex[:8]
        folder, ids, name = nodes.folder, nodes.ids, self.name

        def write(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            p, known, s, d = TaskContext.get().partitionId(), None, [], []
            for b in batches:
                known = ids.read() if known is None else known
                small = np.int32 if len(known) < 2**31 else np.int64
                s.append(np.searchsorted(known, b.column(0).to_numpy()).astype(small))
                d.append(np.searchsorted(known, b.column(1).to_numpy()).astype(small))
            if s:
                s, d = np.concatenate(s), np.concatenate(d)
                _put(folder, f"{name}.src.{p}", s)
                _put(folder, f"{name}.dst.{p}", d)
                yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int64()), "last": pa.array([int(d[-1])], pa.int64())})

        parts = max(1, -(-edges.count() // nodes.part))
        ends = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).repartitionByRange(parts, "d").sortWithinPartitions("d", "s")
        got = sorted(map(tuple, ends.mapInArrow(write, "p long, last long").collect()))
        cuts = [0] + [last + 1 for _, last in got[:-1]] + [nodes.n]
        self.parts = [(cuts[i], cuts[i + 1], p) for i, (p, _) in enumerate(got)] if got else [(0, nodes.n, None)]

    def round(self, do, reads: list[Vector], writes: int) -> tuple[list[Vector], np.ndarray]:
        """``do(part, *vectors) -> (its part of each new vector, numbers)``: the new vectors and the numbers added up over the parts."""
        folder, name, parts, turn = self.nodes.folder, self.name, self.parts, uuid.uuid4().hex[:8]

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for i in b.column(0).to_pylist():
                    lo, hi, p = parts[i]
                    none = np.zeros(0, np.int32)
                    part = Part(lo, hi, none, none) if p is None else Part(lo, hi, _get(folder, f"{name}.src.{p}"), _get(folder, f"{name}.dst.{p}"))
                    made, numbers = do(part, *[v.read() for v in reads])
                    for w in range(writes):
                        _put(folder, f"{turn}.{w}.{i}", made[w])
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "x": pa.array([[float(x) for x in numbers]], pa.list_(pa.float64()))})

        rows = self.nodes.spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "i long, x array<double>").collect()
        total = np.sum([r.x for r in sorted(rows)], axis=0)
        return [Vector(folder, self.nodes.n, [(lo, hi, f"{turn}.{w}.{i}") for i, (lo, hi, _) in enumerate(parts)]) for w in range(writes)], total


class Slices(Edges):
    """Ranges of nodes without edges, for rounds that need none."""

    def __init__(self, nodes: Nodes) -> None:
        self.nodes, self.name = nodes, ""
        self.parts = [(lo, min(nodes.n, lo + nodes.part), None) for lo in range(0, max(1, nodes.n), nodes.part)]


def spark_hash(node: np.ndarray, number: int) -> np.ndarray:
    """Spark's ``xxhash64(node, number)`` of longs and one int, as signed 64-bit numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def mix(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8) ^ turn(node.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = mix(turn(h, 27) * p1 + p4)
        h = h + p5 + np.uint64(4) ^ np.array([number & 0xFFFFFFFF], np.uint64) * p1
        return mix(turn(h, 23) * p2 + p3).view(np.int64)
