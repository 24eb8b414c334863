"""N-gram Jaccard join by banded MinHash labels and exact verification.

A document is its set of distinct five-word shingles (lower-cased A-Z; words are
runs of letters, digits and non-ASCII characters; a text of fewer words, but not
none, has one shingle of all its words).

1. Documents of equal sets form a class, led by the least doc_id; only leaders go on.
2. Each leader has ``TREES`` labels of ``DEEPEST`` MinHash bytes, cut to one fixed
   prefix: the longest with which a pair at the threshold shares one in some tree
   with probability ``target``.  This is fixed banding, in place of an LSH forest:
   no label is sorted and no prefix is shortened from the data.
3. Leaders under one prefix are tied to the least of them (a star, never all
   pairs), and the stars' connected components bound what can be similar.
4. Each component's sets come together in squares of at most ``SQUARE`` x ``SQUARE``
   leaders, so a component of any size is spread over many tasks.  Intersections of
   all pairs of a square are counted exactly; a task returns one row for each leader
   with its number of links, and a spanning forest of them, not the pairs.

Counting the links of n different texts that are all alike takes n squared
comparisons by definition; they are spread, bounded in memory and never rows.

Defined results: a null text, or one without a word, is a class of its own without
links; every row is reported, repeated rows as copies of each other; rows of one
doc_id with several texts are judged by their texts; a class of rows without any
doc_id has class_id null; an empty table gives no rows; other columns are ignored
by :func:`similar_classes` and kept by :func:`keep_one_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.iterate import components
from classlake.llm import words as W
from classlake.llm.shared import bounded_batches, drop, tidied, written

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEEPEST = 8
TARGET = 0.995
SQUARE = 4096
TILE = 1024
WIDTH = 2048
PIECE = 4 << 20
_ID = np.uint64((1 << 44) - 1)
_MULTIPLY = np.random.default_rng(99).integers(1, 2**32, (2, TREES * DEEPEST), dtype=np.uint64).astype(np.uint32)


def prefix_depth(threshold: float, target: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix that reaches the target recall for a pair at the threshold, 1 at least."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text in order, first of each text and the total), 44 bits each."""
    gram, first = W.grams(*W.words(raw, off), SHINGLE, short=True)
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=W.U), np.diff(first))
    key = np.sort((doc << W.U(44)) | (gram >> W.U(20)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & _ID, np.searchsorted(key, np.arange(n + 1, dtype=W.U) << W.U(44))


def labels(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit label for each text and tree: DEEPEST MinHash bytes, the first one highest."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, TREES), W.U)
    if not len(some):
        return out
    x = (W.mix(shingles) >> W.U(32)).astype(np.uint32)
    for t in range(TREES):
        for k in range(DEEPEST):
            j = t * DEEPEST + k
            low = np.minimum.reduceat(x * (_MULTIPLY[0, j] | np.uint32(1)) + _MULTIPLY[1, j], first[:-1][some])
            out[some, t] |= (W.mix(low.astype(W.U) + W.U(j << 33)) & W.U(255)) << W.U(8 * (DEEPEST - 1 - k))
    return out


def _digests(shingles: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, W.U), np.cumsum(W.mix(shingles + W.U(salt << 50)), dtype=W.U)])
    return W.mix(total[first[1:]] - total[first[:-1]]).view(np.int64)


def _signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, check, labels): node, a digest, is the name of an equal set from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            for i, j in W.runs(off, PIECE):
                sh, first = shingle_sets(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                own = labels(sh, first).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[i:j], batch.column("text_hash")[i:j], pa.array(np.diff(first)), pa.array(_digests(sh, first, 1)),
                    pa.array(_digests(sh, first, 2)),
                    pa.ListArray.from_arrays(np.arange(0, own.size + 1, TREES, dtype=np.int32), own.ravel()),
                ], names=["doc_id", "text_hash", "n_shingles", "node", "check", "labels"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       _text_hash(text).alias("text_hash")).mapInArrow(
        tidied(run), "doc_id long, text_hash long, n_shingles long, node long, check long, labels array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(..., set, own) from (..., text): the shingles as packed 64-bit numbers, and their digest."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            for i, j in W.runs(off, PIECE):
                sh, first = shingle_sets(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                sets = [sh[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[i:j] for c in rest] + [
                        pa.array(sets, pa.binary()), pa.array(_digests(sh, first, 1))], names=[*rest, "set", "own"])

    return docs.mapInArrow(tidied(run), docs.select(*rest, F.lit(None).cast("binary").alias("set"),
                                            F.lit(None).cast("long").alias("own")).schema)


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: frequent shingles by matrix product, rare ones pair by pair."""
    na, nb = len(a), len(b)
    value = np.concatenate([*a, *b])
    row = np.repeat(np.arange(na + nb), [len(x) for x in (*a, *b)])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.concatenate([edge, [len(value)]]))
    col = np.repeat(np.arange(len(edge)), size)
    left = np.bincount(col[row < na], minlength=len(edge))
    right = size - left
    both = (left > 0) & (right > 0)
    often = both & (left * right > na * nb / 256)  # where a dense column is cheaper than its pairs
    out = np.zeros((na, nb), np.float32)
    number = np.cumsum(often) - 1
    use = often[col]
    r, c = row[use], number[col[use]]
    for at in range(0, int(often.sum()), WIDTH):
        lo, hi = np.searchsorted(c, (at, at + WIDTH))
        dense = np.zeros((na + nb, WIDTH), np.float32)
        dense[r[lo:hi], c[lo:hi] - at] = 1
        out += dense[:na] @ dense[na:].T
    flat = out.reshape(-1)
    rare = np.flatnonzero(both & ~often)
    # left rows stand before right rows within a shingle, as rows are in order
    for part in np.array_split(rare, 1 + (int((left[rare] * right[rare]).sum()) >> 22)):
        pairs = left[part] * right[part]
        k = np.repeat(part, pairs)
        at = np.arange(len(k)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        x = row[edge[k] + at // right[k]]
        y = row[edge[k] + left[k] + at % right[k]] - na
        np.add.at(flat, x * nb + y, np.float32(1))
    return out


def _square(group: pa.Table, threshold: float) -> pa.Table:
    """Links of one square: a row for each node with links, and the edges of a spanning forest."""
    group = group.sort_by("node")
    node = group["node"].to_numpy()
    copies = group["copies"].to_numpy()
    block = group["block"].to_numpy()
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    sets = [np.frombuffer(x, W.U) for x in group["set"].to_pylist()]
    rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
    size = np.array([len(s) for s in sets], np.float32)
    links = np.zeros(len(sets), np.int64)
    near = np.zeros((len(rows), len(cols)), bool)
    for p in range(0, len(rows), TILE):
        for q in range(0, len(cols), TILE):
            if i == j and q < p:
                near[p:p + TILE, q:q + TILE] = near[q:q + TILE, p:p + TILE].T
                continue
            x, y = rows[p:p + TILE], cols[q:q + TILE]
            shared = intersections([sets[k] for k in x], [sets[k] for k in y])
            near[p:p + TILE, q:q + TILE] = shared >= threshold * (size[x][:, None] + size[y][None, :] - shared) - 1e-3
    if i == j:
        np.fill_diagonal(near, False)
    links[rows] += near @ copies[cols]
    if i != j:
        links[cols] += copies[rows] @ near
    # spanning forest: breadth first over the matrix
    edges: list[tuple[int, int]] = []
    names = rows if i == j else np.concatenate([rows, cols])
    open_ = np.ones(len(names), bool)
    for s in range(len(names)):
        if not open_[s]:
            continue
        open_[s] = False
        queue = [s]
        while queue:
            v = queue.pop()
            if i == j:
                reach = np.flatnonzero(near[v] & open_)
            elif v < len(rows):
                reach = len(rows) + np.flatnonzero(near[v] & open_[len(rows):])
            else:
                reach = np.flatnonzero(near[:, v - len(rows)] & open_[:len(rows)])
            open_[reach] = False
            queue += reach.tolist()
            edges += [(v, w) for w in reach.tolist()]
    some = np.flatnonzero(links)
    tied = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({
        "node": pa.array(np.concatenate([node[some], node[names[tied[:, 0]]]])),
        "other": pa.array([None] * len(some) + node[names[tied[:, 1]]].tolist(), pa.int64()),
        "n_links": pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)])),
    })


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    target: float = TARGET, square: int = SQUARE) -> DataFrame:
    """Per document row: doc_id, leader (least doc_id of its class of equal sets), n_copies (documents in that
    class), class_id (least doc_id of its connected component of links), n_links (other documents, copies
    included, whose similarity is at least the threshold), n_shingles, text_hash, group (a number of the component)."""
    bounded_batches(docs.sparkSession)
    sig = written(_signatures(docs, doc_id, text))
    same = ["n_shingles", "node", "check"]
    lead = written(sig.filter("n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels")))
    depth = prefix_depth(threshold, target)
    under = lead.select("node", F.posexplode("labels").alias("tree", "label")).select(
        "node", F.xxhash64("tree", F.shiftrightunsigned("label", 8 * (DEEPEST - depth))).alias("prefix"))
    first = under.groupBy("prefix").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    star = written(under.join(first.filter("least < most"), "prefix").filter("node <> least")
                   .select("node", "least").distinct())
    member = written(components(star, "node", "least"))
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = (
        lead.select("node", "leader", "copies").join(member, "node").join(size, "component")
        .withColumn("blocks", F.ceil(F.col("n") / square).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = _sets(own.filter("text is not null").join(placed, F.col("doc_id").eqNullSafe(F.col("leader")))
                 .select("node", "component", "copies", "blocks", "block", "text"))
    # a doc_id that stands for several texts brings them all; the set tells which one is meant
    sets = written(sets.filter("own = node").dropDuplicates(["node"]))
    squares = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select(
        "node", "copies", "block", "set", "component", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    found = written(squares.groupBy("component", "i", "j").applyInArrow(
        lambda key, group: _square(group, threshold), "node long, other long, n_links long"))
    drop(star, sets)
    tied = components(found.filter("other is not null"), "node", "other")
    links = found.groupBy("node").agg(F.sum("n_links").alias("linked"))
    least = tied.join(lead.select("node", "leader"), "node").groupBy("component").agg(F.min("leader").alias("class_id"))
    per_class = (
        lead.select(*same, "leader", "copies").join(tied.join(least, "component"), "node", "left")
        .join(links, "node", "left").select(
            *same, "leader", "copies", F.coalesce("class_id", "leader").alias("class_id"),
            F.coalesce("component", "node").alias("group"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return sig.select("doc_id", "text_hash", *same).join(per_class, same, "left").select(
        "doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("leader")).alias("leader"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_shingles", "text_hash",
        F.coalesce("group", F.xxhash64("doc_id", "text_hash")).alias("group"))


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row, all columns, of each component: the one with the least doc_id, then digest of its text.

    A row without a doc_id leads only where no other has one.  Documents without a word all stay; of rows equal in doc_id
    and text one is kept.
    """
    found = similar_classes(docs, doc_id, text, **options)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    kept = first.select(F.col("f.doc_id").alias("_kept_id"), F.col("f.text_hash").alias("_kept_text")).distinct()
    rows = docs.withColumn("_kept_hash", _text_hash(text))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_kept_hash") == F.col("_kept_text"))
    return rows.join(kept, same, "left_semi").dropDuplicates([doc_id, "_kept_hash"]).drop("_kept_hash")


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.col(text).cast("string"))
