"""Product codes of integer vectors, with a trie over distinct parts.

Vectors become integers and are cut into ``PARTS`` consecutive parts.  Each part
position has a codebook that is refined for some rounds: every part goes to its nearest
entry, every entry becomes the floor of its parts' mean.

Each task's distinct parts, copies added up first, are dealt out by their
lexicographic order, so one task's parts agree in their first dimensions.  There a
lexicographic trie is walked depth first: a node holds, for all entries at once, the
distance over the dimensions that its parts have in common, and its children add theirs
to that.  Stretches without a branch are one edge.  At the leaves the nearest entry is
taken, and parts times their numbers are summed for it.  What a round sends on is one
sum for each (entry, dimension) and task; the codebooks, of fixed size, are all that the
driver holds.

Arithmetic is exact: in doubles while distances stay below 2 ** 53, in 64-bit integers
below 2 ** 63, in Python's integers beyond.

Defined results: vectors that are null or hold a null or non-finite component take no
part; shorter ones have zeros behind, up to the longest one's size or the next multiple
of ``PARTS``; components stop at plus and minus 2 ** 62, errors at 2 ** 63 - 1; rows that
share a vec_id are rows of their own, in array order; a null vec_id comes last; with
fewer vectors than entries, the codebooks are that much smaller; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.llm.shared import bounded_batches, drop, tidied, written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LARGEST, LONG = 2**62, 2**63 - 1
LEAVES = 2048   # leaves measured at once
HOT = 64        # a label with more than one row in so many is hot, so there are fewer hot ones


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the vectors that take part, as integers."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.greatest(F.least(F.floor(x * scale).cast("long"), F.lit(LARGEST)), F.lit(-LARGEST))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                           F.col("embedding").cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & ~bad).select("vec_id", "label", F.transform("v", whole).alias("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros behind."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


def distinct(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, sums of weights, place of each row)."""
    order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))
    rows = x[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.diff(np.append(first, len(rows))) if weight is None else np.add.reduceat(weight[order], first)
    return rows[first], total, place


def _kind(rows: np.ndarray, entries: np.ndarray):
    """The type that holds all distances, and the sums on the way, exactly."""
    reach = max(int(rows.max(initial=0)), -int(rows.min(initial=0))) + max((abs(int(e)) for e in entries.ravel()), default=0)
    most = rows.shape[1] * reach**2
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for distinct rows in lexicographic order; ties to the lower entry.

    A trie node is a range of rows and the number of dimensions that they share.  The
    walk keeps one accumulated vector for each node on the way down.  Leaves wait until
    there are ``LEAVES`` of them; then the rest of their dimensions is added for all at
    once, expanded as x^2 - 2 x e + e^2.
    """
    m, d = rows.shape
    kind = _kind(rows, entries)
    x, e = rows.astype(kind), entries.astype(kind)
    shared = np.zeros(m, np.int64)  # dimensions that a row has in common with the one before
    if m > 1:
        differs = rows[1:] != rows[:-1]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), d)
    behind = np.zeros((d + 1, len(e)), kind)  # squares of the entries from a dimension on
    behind[:d] = np.cumsum((e * e).T[::-1], axis=0)[::-1] if d else behind[:d]
    code, far = np.zeros(m, np.int64), np.zeros(m, object if kind is object else np.int64)
    leaves: list[tuple[np.ndarray, int, int]] = []  # (rows, shared dimensions, accumulated vector)
    sums: list[np.ndarray] = []
    waiting = 0

    def measure() -> None:
        nonlocal waiting
        at = np.concatenate([r for r, _, _ in leaves])
        depth = np.repeat([c for _, c, _ in leaves], [len(r) for r, _, _ in leaves])
        node = np.repeat([s for _, _, s in leaves], [len(r) for r, _, _ in leaves])
        rest = np.where(np.arange(d)[None, :] >= depth[:, None], x[at], 0)
        dist = np.stack(sums)[node] + behind[depth] + (rest * rest).sum(axis=1)[:, None] - 2 * (rest @ e.T)
        best = dist.argmin(axis=1)
        code[at], far[at] = best, dist[np.arange(len(at)), best]
        leaves.clear()
        sums.clear()
        waiting = 0

    stack = [(0, m, 0, np.zeros(len(e), kind))] if m else []
    while stack:
        lo, hi, depth, acc = stack.pop()
        inner = shared[lo + 1:hi]
        common = int(inner.min()) if len(inner) else depth
        if common > depth:  # one edge over all dimensions that the whole range shares
            step = x[lo, depth:common][None, :] - e[:, depth:common]
            acc = acc + (step * step).sum(axis=1)
        cuts = np.concatenate([[lo], lo + 1 + np.flatnonzero(inner == common), [hi]]) if len(inner) else np.array([lo, hi])
        size = np.diff(cuts)
        single = cuts[:-1][size == 1]
        for i in range(0, len(single), LEAVES):
            leaves.append((single[i:i + LEAVES], common, len(sums)))
            sums.append(acc)
            waiting += len(leaves[-1][0])
            if waiting >= LEAVES:
                measure()
        for k in np.flatnonzero(size > 1)[::-1]:
            stack.append((int(cuts[k]), int(cuts[k + 1]), common, acc))
    if leaves:
        measure()
    return code, far


def _cut(x: np.ndarray, part: int, width: int) -> np.ndarray:
    return x[:, part * width:(part + 1) * width]


def _distinct_parts(vectors: DataFrame, width: int) -> DataFrame:
    """(part, x, n): distinct parts of all vectors, up to copies that tasks hold apart, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), PARTS * width)
            for part in range(PARTS if len(x) else 0):
                rows, n, _ = distinct(_cut(x, part, width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), part), pa.int32()), lists, pa.array(n)], names=["part", "x", "n"])

    found = vectors.select("x").mapInArrow(tidied(run), "part int, x array<long>, n long")
    return found.repartitionByRange("part", "x").sortWithinPartitions("part", "x")


def _round(parts: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), width + 1), object) for b in books]  # sums of the parts, and their number
        for batch in batches:
            of = batch.column("part").to_numpy()
            x, n = matrix(batch.column("x"), width), batch.column("n").to_numpy()
            for part in np.unique(of):
                rows, weight, _ = distinct(x[of == part], n[of == part])
                code, _ = nearest(rows, books[part])
                order = np.argsort(code, kind="stable")
                entry, first = np.unique(code[order], return_index=True)
                most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)), 1) * int(weight.sum())
                kind = np.int64 if most < 2**63 else object
                both = np.column_stack([rows.astype(kind) * weight.astype(kind)[:, None], weight.astype(kind)])
                totals[part][entry] += np.add.reduceat(both[order], first, axis=0).astype(object)
        rows = [(part, entry, place, Decimal(int(v))) for part, total in enumerate(totals)
                for entry in np.flatnonzero(total[:, width] != 0).tolist() for place, v in enumerate(total[entry])]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.decimal128(38, 0))],
            names=["part", "entry", "place", "s"])

    sums = parts.mapInArrow(tidied(run), "part int, entry int, place int, s decimal(38,0)").groupBy(
        "part", "entry", "place").agg(F.sum("s").alias("s"))
    total = {(r.part, r.entry, r.place): int(r.s) for r in sums.collect()}  # at most PARTS * ENTRIES * (width + 1) rows
    out = [b.copy() for b in books]
    for (part, entry, place), s in total.items():
        if place < width:
            out[part][entry, place] = s // total[part, entry, width]
    return out


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of the vectors that :func:`scaled` gives: for each part position, entries x dimensions of Python integers."""
    bounded_batches(vectors.sparkSession)
    size = vectors.agg(F.max(F.size("x")).alias("m")).first().m
    width = max(1, -(-(size or 0) // PARTS))
    first = vectors.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    start = np.array([[*r.x, *[0] * (PARTS * width - len(r.x))] for r in first], object).reshape(len(first), PARTS * width)
    books = [_cut(start, part, width).copy() for part in range(PARTS)]
    if first and rounds:
        parts = written(_distinct_parts(vectors, width))
        for _ in range(rounds):
            books = _round(parts, books, width)
        drop(parts)
    return books


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): the nearest entries, two hex digits each, and the squared distance to them."""
    bounded_batches(vectors.sparkSession)
    width = books[0].shape[1]
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), PARTS * width)
            codes, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), object)
            for part, book in enumerate(books):
                rows, _, place = distinct(_cut(x, part, width))
                code, far = nearest(rows, book)
                codes[:, part] = code[place]
                error += far[place].astype(object)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"),
                pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                pa.array([min(v, LONG) for v in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "x").mapInArrow(
        tidied(run), f"vec_id long, label {label}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the sum of errors over equal labels, nulls together.

    Labels with more than one row in ``HOT`` (fewer than ``HOT`` of them) meet their sums
    by a broadcast, so none of them is dealt to one task; the others are joined.
    """
    sums = written(codes.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"),
        F.count(F.lit(1)).alias("rows")))
    rows = sums.agg(F.sum("rows").alias("n")).first().n or 0
    sums = sums.withColumnRenamed("label", "sum_label")
    hot = F.broadcast(sums.filter(F.col("rows") * HOT > rows).drop("rows"))
    same = F.col("label").eqNullSafe(F.col("sum_label"))
    often = codes.join(hot, same)
    seldom = codes.join(hot.select("sum_label"), same, "left_anti").join(
        sums.filter(F.col("rows") * HOT <= rows).drop("rows"), same)
    return often.unionByName(seldom).drop("sum_label")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of all vectors, and the codebooks."""
    whole = written(scaled(vectors))
    books = train(whole, entries, rounds)
    return with_label_errors(written(coded(whole, books))), books
