"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each Arrow batch of documents is a shard: its word suffixes that share their
first words with some test suffix are sorted into a suffix array, every test
suffix is binary-searched in it, and the array's range gives all verbatim
places.  Shards share nothing, so documents are never shuffled, and copies of a
document or a passage that many documents hold cost no more than other text.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters,
told apart by 64-bit hashes.  Test items go to the tasks in blocks of at most
``block_bytes`` bytes of text each; every block is matched against all documents.

Defined results: a null or empty text has no words and is never contaminated; a
null or empty item has no window; items of fewer than ``window`` words are one
window; an item id that is null counts as ''; repeated document rows are judged
each for itself; repeated items count once per id; empty tables give no rows or
no hits; further columns are carried along by :func:`remove_contaminated` and
ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.llm import words as W
from classlake.llm.shared import bounded_batches, tidied, written

WINDOW = 13
LEAST_SHARE = 20  # contaminated if at least one word in so many is hit
STEM = 3          # words that a suffix must share with a test suffix to enter the array
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20


@dataclass
class Tests:
    """Test suffixes of one block of items."""

    vocabulary: np.ndarray  # sorted word hashes; id = place + 1
    ids: list[np.ndarray]   # word ids of each item
    names: list[str]
    stems: np.ndarray       # sorted hashes of the suffixes' first words
    stem: int
    bits: int
    suffix: np.ndarray      # packed ids of the distinct windows, zeros behind
    length: np.ndarray      # words in each
    of: tuple[np.ndarray, np.ndarray]  # (window, item) pairs, sorted by window
    place: list[tuple[int, int]]       # (item, word) where each distinct window first stands


def prepare(items: list[tuple[str, str | None]], window: int) -> Tests | None:
    """Vocabulary and distinct windows of ``(id, text)`` pairs; None if there is no word."""
    raw, off = W.texts(pa.array([t for _, t in items], pa.large_string()))
    hashes, first = W.words(raw, off)
    if not len(hashes):
        return None
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    per = [ids[a:b] + 1 for a, b in zip(first[:-1], first[1:], strict=True)]
    seen: dict[bytes, int] = {}
    pairs: set[tuple[int, int]] = set()
    rows: list[np.ndarray] = []
    place: list[tuple[int, int]] = []
    for i, w in enumerate(per):
        for s in range(max(1, len(w) - window + 1) if len(w) else 0):
            part = w[s:s + window]
            k = seen.setdefault(part.tobytes(), len(rows))
            if k == len(rows):
                rows.append(part)
                place.append((i, s))
            pairs.add((k, i))
    length = np.array([len(r) for r in rows])
    padded = np.zeros((len(rows), window), np.int64)
    for k, r in enumerate(rows):
        padded[k, :len(r)] = r
    bits = int(len(vocabulary) + 2).bit_length()
    stem = int(min(STEM, length.min()))
    pair = np.array(sorted(pairs))
    return Tests(vocabulary, per, [n for n, _ in items], np.unique(_stem(padded, stem)), stem, bits,
                 _pack(padded, bits), length, (pair[:, 0], pair[:, 1]), place)


def _stem(ids: np.ndarray, stem: int) -> np.ndarray:
    out = np.zeros(len(ids), W.U)
    for k in range(stem):
        out = W.mix(out * W.U(31) + ids[:, k].astype(W.U))
    return out


def _pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Word ids side by side in 64-bit keys, so that key order is word order."""
    per = 64 // bits
    cols = -(-ids.shape[1] // per)
    out = np.zeros((len(ids), cols), W.U)
    for k in range(ids.shape[1]):
        out[:, k // per] |= ids[:, k].astype(W.U) << W.U(64 - bits * (k % per + 1))
    return out


def _bound(keys: np.ndarray, probe: np.ndarray, after: bool) -> np.ndarray:
    """First place in the sorted ``keys`` not below (or, ``after``, above) each probe."""
    lo, hi = np.zeros(len(probe), np.int64), np.full(len(probe), len(keys))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        row = keys[np.minimum(mid, len(keys) - 1)]
        less, same = np.zeros(len(probe), bool), np.ones(len(probe), bool)
        for c in range(keys.shape[1]):
            less |= same & (row[:, c] < probe[:, c])
            same &= row[:, c] == probe[:, c]
        go = open_ & (less | (same if after else False))
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def suffix_array(ids: np.ndarray, places: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, their packed first ``depth`` words)."""
    table = np.zeros((len(places), depth), np.int64)
    for k in range(depth):
        at = places + k
        table[:, k] = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], 0)
    keys = _pack(table, bits)
    order = np.lexsort(keys.T[::-1])
    return places[order], keys[order]


def search(raw: np.ndarray, off: np.ndarray, tests: Tests, window: int):
    """Occurrences in one shard: (first word of each document, its word ids with a 0 after each document,
    window of each occurrence, its word place).  Places count the zeros."""
    hashes, first = W.words(raw, off)
    near = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    known = np.where(tests.vocabulary[near] == hashes, near + 1, 0)
    ids = np.zeros(len(hashes) + len(first) + window, np.int64)  # no match runs over a document's end
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ids[np.arange(len(hashes)) + doc] = known
    begin = first + np.arange(len(first))
    places = np.flatnonzero(ids)
    for k in range(1, tests.stem):
        places = places[ids[places + k] > 0]
    code = _stem(np.stack([ids[places + k] for k in range(tests.stem)], axis=1), tests.stem)
    hit = np.minimum(np.searchsorted(tests.stems, code), len(tests.stems) - 1)
    places = places[tests.stems[hit] == code]
    if not len(places):
        return begin, ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, keys = suffix_array(ids, places, window, tests.bits)
    low = _bound(keys, tests.suffix, after=False)
    top = tests.suffix.copy()
    per = 64 // tests.bits
    for k in range(window):  # words behind a short window may be any
        top[:, k // per] |= np.where(tests.length <= k, (1 << tests.bits) - 1, 0).astype(W.U) << W.U(
            64 - tests.bits * (k % per + 1))
    high = _bound(keys, top, after=True)
    size = high - low
    which = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    return begin, ids, which, order[at]


def _runs(begin: np.ndarray, ids: np.ndarray, which: np.ndarray, at: np.ndarray, tests: Tests) -> np.ndarray:
    """Which word places are hit."""
    change = np.zeros(len(ids) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + tests.length[which], -1)
    return np.cumsum(change[:-1]) > 0


def _marked(docs: DataFrame, tests: Tests, window: int, last: bool) -> DataFrame:
    """Rows (row, text, found) with the hits of one block added to ``found``; the ``last`` block leaves out the text."""
    keep = [c for c in docs.columns if not (last and c == "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            before = batch.column("found").to_pylist()
            found = []
            for i, j in W.runs(off, SHARD_BYTES):
                begin, ids, which, at = search(raw[off[i]:off[j]], off[i:j + 1] - off[i], tests, window)
                hit = _runs(begin, ids, which, at, tests)
                owner = np.searchsorted(begin, at, side="right") - 1
                pair = np.unique(owner * len(tests.length) + which)
                touched = set((pair // len(tests.length)).tolist())
                names: dict[int, set[str]] = {d: set() for d in touched}
                lo = np.searchsorted(tests.of[0], pair % len(tests.length), side="left")
                hi = np.searchsorted(tests.of[0], pair % len(tests.length), side="right")
                for d, a, b in zip((pair // len(tests.length)).tolist(), lo, hi, strict=True):
                    names[d].update(tests.names[x] for x in tests.of[1][a:b])
                for d in range(j - i):
                    a, b = int(begin[d]), int(begin[d + 1]) - 1
                    old = before[i + d]
                    if d not in touched:
                        found.append({**old, "n_words": b - a})
                        continue
                    here = hit[a:b].copy()
                    for s, e in zip(old["hits"][::2], old["hits"][1::2], strict=True):
                        here[s:e] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
                    found.append({"n_words": b - a, "hits": edge.tolist(),
                                  "items": sorted({*old["items"], *names[d]})})
            kind = batch.schema.field("found").type
            cols = {"row": batch.column("row"), "text": batch.column("text"), "found": pa.array(found, kind)}
            yield pa.RecordBatch.from_arrays(
                [cols[c] for c in keep], schema=pa.schema([batch.schema.field(c) for c in keep]))

    return docs.mapInArrow(tidied(run), docs.select(*keep).schema)


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Blocks of items of a bounded size, one on the driver at a time."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
                        F.col(text).cast("string").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = 1 + 2 * size // block_bytes
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k)
        yield [(r.id, r.t) for r in part.collect()]


def _found(docs: DataFrame, items: DataFrame, row: list[str], text: str, item_id: str, item_text: str,
           window: int, block_bytes: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    start = F.struct(
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("hits"),
        F.array().cast("array<string>").alias("items"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"),
                      F.col(text).cast("string").alias("text"), start.alias("found"))
    held, done = None, 0
    for block in _blocks(items, item_id, item_text, block_bytes):
        tests = prepare(block, window)
        if tests is None:
            continue
        if held is not None:
            out, done = _marked(out, held, window, last=False), done + 1
            if done % 4 == 0:  # a plan holds few blocks at once
                out = written(out)
        held = tests
    if held is None:  # no item has a word: words are counted, none is hit
        held = prepare([("", "a")], window)
        held.length[:], held.stems[:] = 0, 0
    return _marked(out, held, window, last=True)


def _hit_words() -> F.Column:
    """Sum of the runs' ends less the sum of their starts."""
    return F.aggregate(
        F.transform("found.hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
        F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated(share: int):
    return (_hit_words() > 0) & (share * _hit_words() >= F.col("found.n_words"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  share: int = LEAST_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, hits (word runs), items (sorted ids), contaminated."""
    out = _found(docs, items, [doc_id], text, item_id, item_text, window, block_bytes)
    return out.select(
        F.col(f"row.`{doc_id}`").alias("doc_id"), "found.n_words", _hit_words().alias("n_hit"), "found.hits",
        F.array_sort("found.items").alias("items"), _contaminated(share).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                        item_text: str = "text", window: int = WINDOW, share: int = LEAST_SHARE,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    out = _found(docs, items, docs.columns, text, item_id, item_text, window, block_bytes)
    return out.filter(~_contaminated(share)).select("row.*")


def longest_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of each test suffix of at least a window: item_id, item_word, n_words, doc_id,
    doc_word (word places from 0; ties go to the least document, then place).  Shards send one row for each
    suffix and the best is an aggregate."""
    schema = "item_id string, item_word long, n_words long, doc_id string, doc_word long"
    bounded_batches(docs.sparkSession)
    parts = []
    for block in _blocks(items, item_id, item_text, block_bytes):
        tests = prepare(block, window)
        if tests is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], tests: Tests = tests) -> Iterator[pa.RecordBatch]:
            spots: dict[int, list[tuple[int, int]]] = {}
            index = {tests.ids[i][s:s + window].tobytes(): k for k, (i, s) in enumerate(tests.place)}
            for i, w in enumerate(tests.ids):
                for s in range(max(1, len(w) - window + 1) if len(w) else 0):
                    spots.setdefault(index[w[s:s + window].tobytes()], []).append((i, s))
            for batch in batches:
                raw, off = W.texts(batch.column("text"))
                names = batch.column("doc_id").to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for i, j in W.runs(off, SHARD_BYTES):
                    begin, ids, which, at = search(raw[off[i]:off[j]], off[i:j + 1] - off[i], tests, window)
                    owner = np.searchsorted(begin, at, side="right") - 1
                    for k, p, d in zip(which.tolist(), at.tolist(), owner.tolist(), strict=True):
                        for x, s in spots[k]:
                            w = tests.ids[x][s:]
                            same = ids[p:p + len(w)]
                            n = int(np.argmin(np.concatenate([same == w[:len(same)], [False]])))
                            name = names[i + d]
                            key = (-n, name is not None, name, p - int(begin[d]))
                            if (x, s) not in best or key < best[x, s]:
                                best[x, s] = key
                yield pa.RecordBatch.from_pylist([
                    {"item_id": tests.names[x], "item_word": s, "n_words": -k[0], "doc_id": k[2], "doc_word": k[3]}
                    for (x, s), k in best.items()], pa.schema([
                        ("item_id", pa.string()), ("item_word", pa.int64()), ("n_words", pa.int64()),
                        ("doc_id", pa.string()), ("doc_word", pa.int64())]))

        parts.append(docs.select(F.col(doc_id).cast("string").alias("doc_id"),
                                 F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kind = docs.schema[doc_id].dataType
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").cast(kind).alias("d"),
                          F.col("doc_word").alias("w"))).alias("b")
    return out.groupBy("item_id", "item_word").agg(best).select(
        "item_id", "item_word", (-F.col("b.n")).alias("n_words"), F.col("b.d").alias("doc_id"),
        F.col("b.w").alias("doc_word"))
