"""The most similar vectors of every vector, along shifted Hilbert curves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hybridrank.runtime import Scratch

#: Defaults: how many curves, dimensions and bits of a curve, rows of a window.
CURVES, DIMS, BITS, WINDOW = 10, 10, 6, 2048
#: Further bits of a curve, which order the rows of one cell, down to what single precision tells apart.
FINE = 18


def hilbert_words(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of small integers) along a Hilbert curve: ``(rows, words)``.

    A word holds as many levels as 63 bits can, the highest first; so a longer
    key of a finer grid begins with that of the coarser one.

    Works on all rows at once: first undoes the reflections and rotations of
    each level, from the highest bit down, then takes the Gray code and
    interleaves the bits.
    """
    x = [c.astype(np.uint32) for c in np.asarray(cells).T]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] & np.uint32(1 << level), turn ^ np.uint32((1 << level) - 1), turn)
    words = []
    for top in range(bits, 0, -(63 // n)):
        key = np.zeros(len(turn), np.int64)
        for level in range(top - 1, max(top - 63 // n, 0) - 1, -1):
            for i in range(n):
                key = (key << 1) | (((x[i] ^ turn) >> np.uint32(level)) & np.uint32(1)).astype(np.int64)
        words.append(key)
    return np.stack(words, axis=1)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve, where one word holds them."""
    return hilbert_words(cells, bits)[:, 0]


def curve_keys(unit: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Keys of unit vectors on each curve: ``(rows, curves, words)``.

    Every curve sees its own random orthonormal projection, shifted by a random
    part of the grid.
    """
    d, keys = unit.shape[1], []
    use = min(dims, d)
    for c in range(curves):
        rng = np.random.default_rng([seed, c])
        base = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :use]
        reach = 3.2 / np.sqrt(d)  # a projection of a unit vector seldom goes further
        place = ((unit @ base) / reach + 1) / 4 + rng.uniform(0, 0.5, use)
        keys.append(hilbert_words((np.clip(place, 0, 1 - 1e-9) * (1 << bits)).astype(np.uint32), bits))
    return np.stack(keys, axis=1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _bytes(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Usable:
    """Keeps vectors of ``dims`` finite numbers, not all zero; packs them, and names the class of their direction."""

    def __init__(self, dims: int, kind: str):
        self.dims, self.kind = dims, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A null vector has no length, so it is not taken; a null number reads as not a number.
            fits = pc.fill_null(pc.equal(pc.list_value_length(b.column("vec")), self.dims), False)
            ids, vecs = b.column("id").filter(fits), b.column("vec").filter(fits)
            m = vecs.flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(-1, self.dims)
            good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            m = m[good]
            # Vectors of one direction are one class, whatever their length: cosines tell them apart to twelve digits at most.
            direction = np.round(_unit(m), 10) + 0.0 if len(m) else m
            classes = pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in direction], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), _bytes(m), classes], names=["id", "vec", "cls"])


class _Keys:
    def __init__(self, kind: str, curves: int, use: int, bits: int, seed: int):
        self.kind, self.args = kind, (curves, use, bits, seed)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = self.args[0]
        for b in batches:
            if b.num_rows:
                keys = curve_keys(_unit(_rows(b.column("vec"), self.kind)), *self.args)
                # Big-endian bytes compare like the words.
                each = _bytes(keys.reshape(b.num_rows * curves, -1).astype(">i8"))
                listed = pa.ListArray.from_arrays(np.arange(0, len(each) + 1, curves, dtype=np.int32), each)
                yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("vec"), listed], names=["cls", "vec", "keys"])


#: What a list of neighbours holds for each of them: its row, and the rounded cosine.
NEAR = np.dtype([("near", "<i8"), ("score", "<f8")])


class _Windows:
    """Exact neighbours within the windows of a sorted partition.

    The partition is walked in blocks of half a window; the rows of a block meet
    those of the block itself and of the blocks on either side, each once.
    """

    def __init__(self, kind: str, k: int, window: int):
        self.kind, self.k, self.half = kind, k, max(window // 2, k + 1)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around: list[tuple[np.ndarray, np.ndarray]] = []  # the block before, and the block whose turn it is
        for rows, vecs, last in self._blocks(batches):
            block = (rows, _unit(vecs))
            if around:
                yield from self._nearest(around[-1], [*around, block])
            around = [*around[-1:], block]
            if last:
                yield from self._nearest(block, around)
                around = []

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Blocks of rows of one curve, and whether the curve ends with the block."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        curve = None

        def join() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([r for r, _ in held]), np.concatenate([v for _, v in held])

        for b in batches:
            curves, rows, vecs = b.column("curve").to_numpy(), b.column("row").to_numpy(), None
            cuts = [0, *(np.flatnonzero(np.diff(curves)) + 1), len(curves)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                vecs = _rows(b.column("vec"), self.kind) if vecs is None else vecs
                if held and curves[lo] != curve:
                    yield *join(), True
                    held = []
                curve = curves[lo]
                held.append((rows[lo:hi], vecs[lo:hi]))
                # A block goes out only when more of the curve is there, so that it is known not to be the last.
                while sum(len(r) for r, _ in held) > self.half:
                    r, v = join()
                    yield r[: self.half], v[: self.half], False
                    held = [(r[self.half :], v[self.half :])]
        if held:
            yield *join(), True

    def _nearest(self, block: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, unit = np.concatenate([r for r, _ in others]), np.concatenate([u for _, u in others])
        n = len(rows)
        if n < 2:
            return
        k = min(self.k, n - 1)
        wide = min(k + 3, n - 1)  # single precision finds them, double precision orders them
        single = unit.astype(np.float32)
        place = 0
        for r, _ in others:
            if r is block[0]:
                break
            place += len(r)
        for lo in range(0, len(block[0]), 512):
            mine = unit[place + lo : place + min(lo + 512, len(block[0]))]
            scores = np.full((len(mine), -(-n // 32) * 32), -3, np.float32)
            np.matmul(mine.astype(np.float32), single.T, out=scores[:, :n])
            scores[np.arange(len(mine)), np.arange(place + lo, place + lo + len(mine))] = -3
            near = _largest(scores, wide)
            exact = np.round(np.einsum("ij,ikj->ik", mine, unit[near]), 12)
            order = np.lexsort((rows[near], -exact))[:, :k]
            found = np.empty((len(mine), k), NEAR)
            found["near"], found["score"] = rows[np.take_along_axis(near, order, 1)], np.take_along_axis(exact, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(block[0][lo : lo + len(mine)]), _bytes(found)], names=["row", "found"])


def _largest(scores: np.ndarray, wide: int) -> np.ndarray:
    """The places of the ``wide`` largest numbers of every row; the number of columns is a multiple of 32.

    Columns form groups; the largest numbers lie in the groups of the largest maxima.
    """
    n, columns = scores.shape
    groups = columns // 32
    if groups <= wide:
        return np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
    parted = scores.reshape(n, 32, groups)
    top = np.argpartition(-parted.max(axis=1), wide - 1, axis=1)[:, :wide]
    places = (np.arange(32)[None, :, None] * groups + top[:, None, :]).reshape(n, -1)
    best = np.argpartition(-np.take_along_axis(scores, places, 1), wide - 1, axis=1)[:, :wide]
    return np.take_along_axis(places, best, 1)


class _Merge:
    """The ``k`` best of all lists of a row; rows come sorted."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            each = np.frombuffer(b"".join(found := b.column("found").to_pylist()), NEAR)
            many = np.array([len(x) // NEAR.itemsize for x in found])
            now = (np.repeat(b.column("row").to_numpy(), many), each["near"], each["score"])
            now = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now))
            ends = int(np.searchsorted(now[0], now[0][-1]))  # the last row may go on in the next batch
            if ends:
                yield self._best(*(x[:ends] for x in now))
            rest = tuple(x[ends:] for x in now)
        if rest is not None:
            yield self._best(*rest)

    def _best(self, row: np.ndarray, near: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((near, -score, row))
        row, near, score = row[order], near[order], score[order]
        # Two curves give a neighbour the same rounded score, so its repeats stand together.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
        row, near, score = row[new], near[new], score[new]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        return pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(-score[keep]), pa.array(near[keep])], names=["row", "far", "near"])


def nearest(
    vectors: DataFrame, key: str, vector: str, k: int = 5, dims: int = 64, curves: int = CURVES, curve_dims: int = DIMS, bits: int = BITS, window: int = WINDOW, seed: int = 7
) -> DataFrame:
    """``(key, neighbour, similarity, rank)``: the ``k`` nearest by cosine of every vector.

    Rows whose key is null or whose vector has not ``dims`` finite numbers, or is all zero, take no part.
    Repeated keys count once, with the vector whose bytes are least.  Equal
    similarities are ranked by the neighbour's key.  Fewer than ``k + 1``
    vectors give all the neighbours there are; an empty table gives none.
    Other columns are ignored, whatever their names.

    Vectors of one direction form one class, however large, and only classes are compared,
    so no hot vector fills a window; each class then stands for its first
    ``k + 1`` keys, more than which nobody can have as neighbours.  Classes are
    numbered in the order of their least key, which settles ties.  The classes
    are put in order along several Hilbert curves, of random projections, by a
    range partitioning on (curve, key, row), which parts even equal keys.  A key
    goes on below the grid of ``bits``, so that the rows of a crowded cell are
    in an order of their own on every curve.  Each sorted partition is walked in
    blocks of half of ``window``; a row meets all rows of its block and of the
    two beside it, where neighbours are exact.  Merging a class's lists over all
    curves by the exact cosine gives its neighbours.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    asked = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vec")).where("id is not null")
    kind = "<f8" if asked.schema["vec"].dataType.elementType == T.DoubleType() else "<f4"
    id_type = asked.schema["id"].dataType
    packed = T.StructType([T.StructField("id", id_type), T.StructField("vec", T.BinaryType()), T.StructField("cls", T.BinaryType())])
    rows = scratch.keep(asked.mapInArrow(_Usable(dims, kind), packed).groupBy("id").agg(F.min(F.struct("vec", "cls")).alias("v")).select("id", "v.vec", "v.cls"), "rows")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("n") <= k + 1)
    numbered = first.where("n = 1").repartitionByRange("id").sortWithinPartitions("id").select("cls", "vec")
    classes = numbered.mapInArrow(_Keys(kind, curves, curve_dims, bits + FINE, seed), "cls binary, vec binary, keys array<binary>")
    classes = scratch.keep(classes.withColumn("row", F.monotonically_increasing_id()), "classes")
    placed = classes.select("row", "vec", F.posexplode("keys").alias("curve", "key"))
    found = placed.repartitionByRange("curve", "key", "row").sortWithinPartitions("curve", "key", "row").select("curve", "row", "vec").mapInArrow(_Windows(kind, k, window), "row long, found binary")
    links = found.repartition("row").sortWithinPartitions("row").mapInArrow(_Merge(k), "row long, far double, near long")
    # Back from classes to keys: a class offers its first keys, each with its similarity.
    offers = first.groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(classes.select("cls", "row"), "cls").select("row", "cls", "ids")
    other = offers.select(F.col("row").alias("near"), F.explode("ids").alias("id"))
    listed = links.join(other, "near").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("far", "id"))).alias("others"))
    offered = offers.join(listed, "row", "left").select(
        "cls", F.array_sort(F.concat(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id"))), F.slice(F.coalesce("others", F.array().cast(listed.schema["others"].dataType)), 1, k))).alias("offers")
    )
    mine = rows.select("cls", "id").join(offered, "cls")
    kept = mine.select("id", F.posexplode(F.slice(F.filter("offers", lambda o: o["id"] != F.col("id")), 1, k)).alias("n", "o"))
    return kept.select(F.col("id").alias("key"), F.col("o.id").alias("neighbour"), (-F.col("o.far")).alias("similarity"), (F.col("n") + 1).alias("rank"))
