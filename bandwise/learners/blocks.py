"""Rows packed as matrices, and sums over them: the data of every iterative learner.

A learner reads its prepared rows many times. ``pack`` writes them once to the checkpoint folder, some
thousands of rows to a table row with one binary column for each matrix, so that a pass hands NumPy whole
matrices with no conversion of single values. ``block_sums`` adds a vector over all blocks: one partial
vector a task; where those of all tasks exceed ``DRIVER_BYTES`` they are cut into pieces that are added by
piece in a second step, so that neither the driver nor a task holds more than a few vectors however many tasks there are.

``lockstep`` runs several iterative fits side by side: each step is one pass, whose vector holds the parts
of all fits that are still open. Folds, quantiles, heads and candidates thus cost one pass together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.session import cut_lineage

ROWS = 8192     # rows of a block
PIECE = 16384   # numbers of a piece of a partial vector
DRIVER_BYTES = 16 << 20  # partial vectors of all tasks together that the driver adds by itself

MIXED = "mixed"  # type of a double matrix as ``_mixed`` keeps it

Block = dict[str, np.ndarray]


class Blocks:
    """A written table of blocks: ``shapes`` gives each matrix's type and its number of columns (0: a vector).

    Tables may be joined by ``union`` though their matrices differ in width; a fit then looks at the blocks of its own.
    """

    def __init__(self, df: DataFrame, shapes: Mapping[str, tuple[str, int]]):
        self.df, self.shapes = df, dict(shapes)

        self._tasks = None

    def union(self, other: "Blocks") -> "Blocks":
        return Blocks(self.df.unionByName(other.df), self.shapes)

    def only(self, names: Sequence[str] | None) -> "Blocks":
        """The matrices of ``names`` alone (None: all), so that a pass moves no others."""
        if names is None:
            return self
        keep = [g for g in self.shapes if g in names]
        out = Blocks(self.df.select("n", *keep), {g: self.shapes[g] for g in keep})
        out._tasks = self._tasks
        return out

    def tasks(self) -> int:
        if self._tasks is None:
            self._tasks = self.df.rdd.getNumPartitions()
        return self._tasks


def pack(df: DataFrame, groups: Mapping[str, Sequence[str] | str], types: Mapping[str, str] | None = None, tables: int = 1) -> Blocks:
    """Blocks of ``df``: a matrix of the columns of each list in ``groups``, a vector of each single column.

    Of a double matrix the columns that hold whole numbers from 0 to 255 alone in a block (one-hot ones, say) take a byte a row. Null becomes NaN in double matrices (the default type); other ``types`` must have no nulls. Blocks that lie in fewer
    partitions than the session runs tasks at once (for each of ``tables`` read together its share) are dealt out anew.
    """
    types = dict(types or {})
    shapes = {g: (types.get(g, "<f8"), 0) if isinstance(c, str) else (types.get(g, MIXED), len(c)) for g, c in groups.items()}
    width = {g: 1 if isinstance(c, str) else len(c) for g, c in groups.items()}
    listed = [(g, c) for g, cols in groups.items() for c in ([cols] if isinstance(cols, str) else cols)]
    flat = df.select(*[F.col(c).cast("double" if shapes[g][0] in ("<f8", MIXED) else "long").alias(f"c{i}") for i, (g, c) in enumerate(listed)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for a in range(0, b.num_rows, ROWS):
                at, out, n = 0, [], min(ROWS, b.num_rows - a)
                for g, (kind, _) in shapes.items():
                    m = np.empty((n, width[g]), "<f8" if kind == MIXED else kind)
                    for j in range(width[g]):
                        m[:, j] = cols[at + j][a: a + n]
                    at += width[g]
                    out.append(_mixed(m) if kind == MIXED else m.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32())] + [pa.array([x], pa.binary()) for x in out], ["n", *shapes])

    schema = "n int, " + ", ".join(f"`{g}` binary" for g in shapes)
    packed = cut_lineage(flat.mapInArrow(part, schema))
    want = -(-df.sparkSession.sparkContext.defaultParallelism // tables)
    if packed.rdd.getNumPartitions() < want and packed.rdd.getNumPartitions() < (n := packed.count()):
        # dealt out as plain doubles: Spark deals rows by their content, and sums depend on that order in their last digits
        plain = {g: ("<f8" if kind == MIXED else kind, w) for g, (kind, w) in shapes.items()}
        dealt = packed.mapInArrow(partial(_recast, old=shapes, new=plain), schema).repartition(min(want, n))
        packed = cut_lineage(dealt.mapInArrow(partial(_recast, old=plain, new=shapes), schema))
    return Blocks(packed, shapes)


def _mixed(m: np.ndarray) -> bytes:
    """A double matrix without loss: its other columns as doubles, those of small whole numbers as bytes, and which are which."""
    with np.errstate(invalid="ignore"):
        small = m.astype("u1")
    byte = ((small == m) & ~np.signbit(m)).all(0)
    return m[:, ~byte].tobytes() + small[:, byte].tobytes() + byte.tobytes()


def _recast(batches: Iterator[pa.RecordBatch], old, new) -> Iterator[pa.RecordBatch]:
    """Blocks whose double matrices are of the types ``new`` instead of ``old``."""
    for b in batches:
        for i in range(b.num_rows):
            block = _open(b, i, old)
            cols = [b.column(g).slice(i, 1) if old[g] == new[g] else
                    pa.array([_mixed(block[g]) if new[g][0] == MIXED else block[g].tobytes()], pa.binary()) for g in new]
            yield pa.RecordBatch.from_arrays([b.column("n").slice(i, 1), *cols], ["n", *new])


def _unmixed(held: pa.Buffer, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(held, "u1")
    byte = raw[len(raw) - width:].astype(bool)
    wide = width - int(byte.sum())
    out = np.empty((n, width))
    for at, part in ((~byte, np.frombuffer(held, "<f8", n * wide).reshape(n, wide)), (byte, raw[8 * n * wide: len(raw) - width].reshape(n, width - wide))):
        for j, c in enumerate(np.flatnonzero(at)):  # column by column: several times as fast as one indexed assignment
            out[:, c] = part[:, j]
    return out


def chosen(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``x[rows]``; no copy where all rows are chosen."""
    return x if rows.all() else x[rows]


def with_ones(x: np.ndarray) -> np.ndarray:
    """[x, 1], a missing value as 0."""
    z = np.ones((len(x), x.shape[1] + 1))
    z[:, :-1] = x
    return z if np.isfinite(x).all() else np.nan_to_num(z, copy=False, nan=0.0)


def _open(batch: pa.RecordBatch, i: int, shapes: Mapping[str, tuple[str, int]]) -> Block:
    n = batch.column("n")[i].as_py()
    out: Block = {"n": np.int64(n)}
    for g, (kind, width) in shapes.items():
        if kind == MIXED:
            out[g] = _unmixed(batch.column(g)[i].as_buffer(), int(n), width)
            continue
        x = np.frombuffer(batch.column(g)[i].as_buffer(), kind)
        out[g] = x.reshape(n, -1) if width else x
    return out


def _partials(batches: Iterator[pa.RecordBatch], fn: Callable[[Block], np.ndarray], shapes) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for i in range(b.num_rows):
            v = np.asarray(fn(_open(b, i, shapes)), float)
            total = v if total is None else total + v
    if total is not None:
        for k, a in enumerate(range(0, len(total), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[a: a + PIECE].tobytes()], pa.binary())], ["k", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist()):
            x = np.frombuffer(v)
            totals[k] = totals[k] + x if k in totals else x
    for k, v in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["k", "v"])


def block_sums(blocks: Blocks, fn: Callable[[Block], np.ndarray], size: int) -> np.ndarray:
    """Sum over all blocks of ``fn(block)``, a vector of ``size`` numbers."""
    pieces = max(1, -(-size // PIECE))
    parts = blocks.df.mapInArrow(partial(_partials, fn=fn, shapes=blocks.shapes), "k int, v binary")
    if blocks.tasks() * size * 8 > DRIVER_BYTES:
        # a second step streams: a piece's partial vectors are added as they come, whatever their number
        tasks = min(pieces, parts.sparkSession.sparkContext.defaultParallelism)
        parts = parts.repartition(tasks, "k").mapInArrow(_added, "k int, v binary")
    out = np.zeros(size)
    found = parts.toArrow()
    for k, v in zip(found.column("k").to_pylist(), found.column("v").to_pylist()):
        v = np.frombuffer(v)
        out[k * PIECE: k * PIECE + len(v)] += v
    return out


def map_blocks(blocks: Blocks, fn: Callable[[Block], Block], shapes: Mapping[str, tuple[str, int]]) -> Blocks:
    """A new written table whose matrices of ``shapes`` come from ``fn`` (the others stay)."""
    old, new = blocks.shapes, {**blocks.shapes, **shapes}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = fn(_open(b, i, old))
                cols = [pa.array([np.ascontiguousarray(out[g], kind).tobytes()], pa.binary()) if g in shapes else b.column(g).slice(i, 1) for g, (kind, _) in new.items()]
                yield pa.RecordBatch.from_arrays([b.column("n").slice(i, 1), *cols], ["n", *new])

    schema = "n int, " + ", ".join(f"`{g}` binary" for g in new)
    return Blocks(cut_lineage(blocks.df.mapInArrow(part, schema)), new)


def merged(blocks: Blocks, rows: int = 3 * ROWS, of: str = "of") -> Blocks:
    """Neighbouring blocks of a partition joined while they have at most ``rows`` rows, and the same number in ``of`` if there is one.

    For passes of many short NumPy steps a row, whose calls cost as much as the work on a small block. Nothing is written.
    """
    names = list(blocks.shapes)
    if any(kind == MIXED for kind, _ in blocks.shapes.values()):
        raise ValueError("matrices that are held as mixed types cannot be joined as they are")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, mark = [], 0, None
        for b in batches:
            for i in range(b.num_rows):
                m, row = b.column("n")[i].as_py(), [b.column(g)[i].as_buffer() for g in names]
                own = row[names.index(of)].to_pybytes()[:1] if of in names else None
                if held and (n + m > rows or own != mark):
                    yield _joined(held, n, names)
                    held, n = [], 0
                held.append(row)
                n, mark = n + m, own
        if held:
            yield _joined(held, n, names)

    schema = "n int, " + ", ".join(f"`{g}` binary" for g in names)
    return Blocks(blocks.df.select("n", *names).mapInArrow(part, schema), blocks.shapes)


def _joined(held: Sequence[Sequence[pa.Buffer]], n: int, names: Sequence[str]) -> pa.RecordBatch:
    cols = [pa.array([b"".join(row[j] for row in held)], pa.binary()) for j in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *cols], ["n", *names])


class Fit:
    """One iterative fit of ``lockstep``: ``size`` numbers from ``part()`` over all blocks, then ``update``.

    ``reads`` names the matrices that ``part()`` looks at (None: any of them).
    """

    size = 0
    reads: Sequence[str] | None = None

    def part(self) -> Callable[[Block], np.ndarray]:
        raise NotImplementedError

    def update(self, total: np.ndarray) -> bool:
        """Take the sums of a pass; False when the fit is done."""
        raise NotImplementedError


def lockstep(blocks: Blocks, fits: Sequence[Fit], after: Callable[[Blocks], Blocks] | None = None, whole: bool = False) -> Blocks:
    """Run ``fits`` until all are done; one pass a step for all that are open.

    Blocks are held, and handed to a pass, with the matrices that the open fits read and no others. ``after`` may
    replace the blocks between two steps (a written state of the fits); returns the last ones, ``whole`` with
    all their matrices.
    """
    live = list(fits)
    if live:
        blocks = blocks if whole else blocks.only(_read(live))
        blocks.tasks()
    held = blocks.df.persist(StorageLevel.MEMORY_AND_DISK) if live else None  # the written table stays the copy to fall back on
    while live:
        sizes, parts = [f.size for f in live], [f.part() for f in live]

        def both(block: Block, parts=parts) -> np.ndarray:
            return np.concatenate([p(block) for p in parts])

        total = block_sums(blocks.only(_read(live)), both, sum(sizes))
        at = np.concatenate([[0], np.cumsum(sizes)])
        live = [f for f, a, b in zip(live, at, at[1:]) if f.update(total[a:b])]
        if after and live:
            now = after(blocks)
            if now is not blocks:
                held.unpersist()
                blocks, held = now, now.df.persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held.unpersist()
    return blocks


def _read(fits: Sequence[Fit]) -> set[str] | None:
    """Matrices that any of ``fits`` reads; None if one may read all."""
    reads = [f.reads for f in fits]
    return None if any(r is None for r in reads) else {g for r in reads for g in r}


class Adam:
    """State of one full-batch Adam descent; a gradient that is not finite raises."""

    def __init__(self, theta: np.ndarray, lr: float = 0.05, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, clip: float = 10.0):
        self.theta, self.lr, self.b1, self.b2, self.eps, self.clip = theta, lr, b1, b2, eps, clip
        self.m, self.v, self.t = np.zeros_like(theta), np.zeros_like(theta), 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        if not np.isfinite(g).all():
            raise FloatingPointError(f"gradient is not finite at step {self.t}: {g}")
        g = np.clip(g, -self.clip, self.clip)
        self.m = self.b1 * self.m + (1 - self.b1) * g
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        rate = self.lr / (1 - self.b1 ** self.t)
        self.theta = self.theta - rate * self.m / (np.sqrt(self.v / (1 - self.b2 ** self.t)) + self.eps)
        return self.theta
