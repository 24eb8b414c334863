"""Scores of texts under a bigram model with Katz backoff.

    P(w | h) = d(c(h, w)) c(h, w) / C(h)   for a bigram seen in training,
               alpha(h) P(w)               otherwise; h never seen: P(w)
    P(w)     = d(c(w)) c(w) / N            for a word seen in training,
               the mass that is left       for all unseen words together

d is the Good-Turing discount of counts up to ``CUT`` and 1 above, alpha(h) makes the
probabilities of all words after h sum to 1 exactly.  Where counts of counts give no
discount between 0 and 1, a count r keeps (r - 1/2) / r; a history (or the
vocabulary) without any discounted count has its total raised by one, so that unseen
words keep some mass.

The work goes through tables in the shared folder, each dealt out by hash:

1. Texts become blocks of local word numbers, each block with its own dictionary.
2. The dictionaries meet by word: counts, numbers by falling frequency, and counts
   of counts; every block gets its words' numbers and counts back.  The vocabulary is
   never in one place.
3. Training bigrams, summed up within a block first, meet by history: the model's
   partitions with counts, and what the backoff weights need.  Histories with a large
   share of all tokens are dealt out by the next word as well; only their sums (at most
   4 for each partition) reach the driver.
4. Bigrams of all texts meet the model's partition, which sends sums for each text back.
   The at most ``COMMON`` most frequent ones are known to every task and need not travel.

Defined results: a null text is empty and has only its end; a null doc_id counts as ''
in the hold-out rule; repeated rows are texts of their own; without a training text
every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.llm import words as W
from classlake.llm.shared import bounded_batches, cleaned_shuffles, drop, new_path, tidied, written

CUT = 5
BLOCK_BYTES = 8 << 20
DEAL_BYTES = 16 << 20
END = W.U(0x5DEECE66D1234567)
COMMON = 1 << 18  # bigrams at most that every task holds
NONE, START = 2**32 - 1, 2**32 - 2  # numbers of a word unseen in training, and of the start of a text


def _blob(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _arrays(table: pa.Table, kinds: dict) -> list[list[np.ndarray]]:
    return [[np.frombuffer(x, k) for x in table[n].to_pylist()] for n, k in kinds.items()]


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array([v], pa.binary() if isinstance(v, bytes) else None) for v in cols.values()],
        names=list(cols))


# ---- 1: blocks
def _blocks(docs: DataFrame) -> DataFrame:
    """One row for each block of texts; ``token`` ends each text with the dictionary's END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            some = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for i, j in W.runs(off, BLOCK_BYTES):
                hashes, first = W.words(raw[off[i]:off[j]], off[i:j + 1] - off[i], W.VISIBLE)
                tokens = np.insert(hashes, first[1:], END)
                size = np.diff(first) + 1
                words, local = np.unique(tokens, return_inverse=True)
                n = np.bincount(local[np.repeat(train[i:j], size)], minlength=len(words))
                yield _batch({
                    "block": uuid.uuid4().hex, "ids": _blob(ids[i:j], np.int64), "some": _blob(some[i:j], np.uint8),
                    "train": _blob(train[i:j], np.uint8), "size": _blob(size, np.uint32),
                    "token": _blob(local, np.uint32), "hash": _blob(words, np.uint64), "n": _blob(n, np.uint32)})

    return docs.mapInArrow(tidied(run), "block string, ids binary, some binary, train binary, size binary, token binary, "
                                "hash binary, n binary")


# ---- 2: words
_WORDS = "block string, p int, number binary, total binary, stats array<long>"


def _count_words(blocks: DataFrame, groups: int) -> DataFrame:
    """Answers to each block (number, total of its words in ``p``), and a row of statistics for each p."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, h, n in zip(*(batch.column(c).to_pylist() for c in ("block", "hash", "n")), strict=True):
                h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32)
                cut = np.searchsorted(h, [W.U((k << 64) // groups) for k in range(groups)]).tolist() + [len(h)]
                for p in range(groups):
                    if cut[p] < cut[p + 1]:
                        part = slice(cut[p], cut[p + 1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p], pa.int32()), pa.array([block]), pa.array([h[part].tobytes()]),
                             pa.array([n[part].tobytes()])], names=["p", "block", "hash", "n"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        hs, ns = _arrays(table, {"hash": np.uint64, "n": np.uint32})
        words, at = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(ns)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -total))] = np.arange(len(words))
        number = rank * groups + p
        if number.max() >= START:
            raise ValueError("more than four billion distinct words")
        number[total == 0] = NONE
        cut = np.cumsum([0] + [len(x) for x in hs])
        own = [at[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        stats = [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, CUT + 2)]]
        return pa.table({
            "block": pa.array([*table["block"].to_pylist(), None], pa.string()),
            "p": pa.array([p] * (len(own) + 1), pa.int32()),
            "number": pa.array([_blob(number[x], np.uint32) for x in own] + [b""], pa.binary()),
            "total": pa.array([_blob(total[x], np.int64) for x in own] + [b""], pa.binary()),
            "stats": pa.array([None] * len(own) + [stats], pa.list_(pa.int64()))})

    dealt = blocks.select("block", "hash", "n").mapInArrow(tidied(deal), "p int, block string, hash binary, n binary")
    return dealt.groupBy("p").applyInArrow(count, _WORDS)


def _known(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the numbers and totals of their words instead of hashes."""

    def whole(c: str) -> F.Column:
        return F.aggregate("a", F.lit(bytearray(b"")), lambda s, x: F.concat(s, x[c])).alias(c)

    rows = answers.filter("block is not null").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("p", "number", "total"))).alias("a"))
    return blocks.drop("hash", "n").join(rows.select("block", whole("number"), whole("total")), "block")


# ---- discounts
def discounts(n: list[int]) -> np.ndarray:
    """Factors d[r] for counts r up to CUT (d[0] is 0) from the counts of counts n[0] = n_1, ..., n[CUT] = n_(CUT+1)."""
    out = np.array([0.0] + [(r - 0.5) / r for r in range(1, CUT + 1)])
    if n[0] > 0:
        over = (CUT + 1) * n[CUT] / n[0]
        for r in range(1, CUT + 1):
            if n[r - 1] > 0 and over < 1:
                d = ((r + 1) * n[r] / (n[r - 1] * r) - over) / (1 - over)
                if 0 < d < 1:
                    out[r] = d
    return out


@dataclass
class Unigrams:
    tokens: int
    words: int
    d: np.ndarray
    whole: int    # denominator
    unseen: float

    @classmethod
    def of(cls, tokens: int, words: int, n: list[int]) -> "Unigrams":
        d = discounts(n)
        low = sum(r * n[r - 1] for r in range(1, CUT + 1))
        kept = float(sum(d[r] * r * n[r - 1] for r in range(1, CUT + 1)))
        whole = tokens if low else tokens + 1
        return cls(tokens, words, d, whole, (whole - (tokens - low) - kept) / whole)

    def p(self, total: np.ndarray) -> np.ndarray:
        """Probability of words of these training counts; 0 stands for all unseen words."""
        out = np.where(total <= CUT, self.d[np.minimum(total, CUT)], 1.0) * total / self.whole
        return np.where(total == 0, self.unseen, out)

    def base(self, total: np.ndarray) -> np.ndarray:
        return np.log10((total + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


# ---- 3: bigrams
_BLOCK = {"ids": np.int64, "some": np.uint8, "train": np.uint8, "size": np.uint32, "token": np.uint32,
          "number": np.uint32, "total": np.int64}


def _decoded(batch: pa.RecordBatch, k: int):
    ids, some, train, size, token, number, total = (
        np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in _BLOCK.items())
    token = token.astype(np.int64)
    before = np.empty(len(token), np.int64)  # the history of each token; the dictionary's length is the start
    before[1:] = token[:-1]
    before[np.cumsum(size) - size] = len(number)
    number = np.append(number, START).astype(np.int64)
    return ids, some == 1, train == 1, size.astype(np.int64), token, before, number, total


def _home(h: np.ndarray, w: np.ndarray, hot: np.ndarray, groups: int) -> np.ndarray:
    """Partition of a bigram: by history, for hot ones by the word as well."""
    return (W.mix(h.astype(W.U) + np.where(hot, (w.astype(W.U) + W.U(1)) << W.U(32), W.U(0))) % W.U(groups)).astype(np.int64)


def _hot(number: np.ndarray, total: np.ndarray, bound: int) -> np.ndarray:
    """Which dictionary words, and the start, hold too many tokens for one partition."""
    return np.append(total > bound, True)


_PAIRS = {"h": np.uint32, "hot": np.uint8, "k": np.uint32, "w": np.uint32, "c": np.uint32, "cw": np.int64}


def _train(blocks: DataFrame, groups: int, bound: int) -> DataFrame:
    """Distinct training bigrams of each block by partition, with their counts and the second word's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                _, _, train, size, token, before, number, total = _decoded(batch, b)
                use = np.repeat(train, size)
                pair, c = np.unique(before[use] * len(number) + token[use], return_counts=True)
                yield from _dealt(pair, c, number, total, _hot(number, total, bound), groups)

    return blocks.mapInArrow(tidied(run), "p int, " + ", ".join(f"{c} binary" for c in _PAIRS))


def _dealt(pair, c, number, total, hot, groups) -> Iterator[pa.RecordBatch]:
    hl, wl = pair // len(number), pair % len(number)
    p = _home(number[hl], number[wl], hot[hl], groups)
    order = np.lexsort((number[wl], number[hl], p))
    p, hl, wl, c = p[order], hl[order], wl[order], c[order]
    for a, z in _stretches(p):
        h = number[hl[a:z]]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        yield _batch({
            "p": pa.array([int(p[a])], pa.int32()), "h": _blob(h[at], np.uint32), "hot": _blob(hot[hl[a:z]][at], np.uint8),
            "k": _blob(np.diff(np.append(at, len(h))), np.uint32), "w": _blob(number[wl[a:z]], np.uint32),
            "c": _blob(c[a:z], np.uint32), "cw": _blob(total[wl[a:z]], np.int64)})


def _stretches(p: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    return zip(at.tolist(), [*at[1:].tolist(), len(p)], strict=True) if len(at) else iter(())


_MODEL = {"h": np.uint32, "k": np.uint32, "w": np.uint32, "c": np.int64, "hot": np.uint8, "tot": np.int64,
          "mass": np.float64, "low": np.int64}


def _model(pairs: DataFrame, uni: Unigrams) -> DataFrame:
    """One row for each partition: bigram counts by history, and for each history its total, the words' mass and the
    numbers of words with counts 1 to CUT; ``stats`` has the counts of counts."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        hs, hots, ks, ws, cs, cws = _arrays(table, _PAIRS)
        h = np.concatenate([np.repeat(x, k) for x, k in zip(hs, ks, strict=True)]).astype(np.uint64)
        hot = np.concatenate([np.repeat(x, k) for x, k in zip(hots, ks, strict=True)])
        code = (h << W.U(32)) | np.concatenate(ws)
        order = np.argsort(code, kind="stable")
        code = code[order]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        c = np.add.reduceat(np.concatenate(cs).astype(np.int64)[order], at)
        cw, hot = np.concatenate(cws)[order][at], hot[order][at]
        h, w = code[at] >> W.U(32), code[at] & W.U(2**32 - 1)
        own = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        low = np.stack([np.add.reduceat((c == r).astype(np.int64), own) for r in range(1, CUT + 1)], axis=1)
        row = {"h": h[own], "k": np.diff(np.append(own, len(h))), "w": w, "c": c, "hot": hot[own],
               "tot": np.add.reduceat(c, own), "mass": np.add.reduceat(uni.p(cw), own), "low": low}
        stats = [int((c == r).sum()) for r in range(1, CUT + 2)]
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()),
                         **{n: pa.array([_blob(row[n], t)], pa.binary()) for n, t in _MODEL.items()},
                         "stats": pa.array([stats], pa.list_(pa.int64()))})

    return pairs.groupBy("p").applyInArrow(
        build, "p int, " + ", ".join(f"{c} binary" for c in _MODEL) + ", stats array<long>")


@dataclass
class Backoff:
    """Discounts of bigrams, and (h, log10 denominator, log10 alpha) of hot histories, sorted by h."""

    d: np.ndarray
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]

    def weights(self, tot: np.ndarray, mass: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 denominator, log10 alpha) of histories."""
        r = np.arange(1, CUT + 1)
        whole = np.where(low.sum(axis=1) > 0, tot, tot + 1).astype(np.float64)
        left = (whole - tot + (low * (r * (1 - self.d[1:]))).sum(axis=1)) / whole
        return np.log10(whole), np.log10(left) - np.log10(np.maximum(1 - mass, 1e-300))


def _opened(row: dict, back: Backoff) -> tuple[np.ndarray, ...]:
    """(h, log10 denominator, log10 alpha, bigram codes, their counts) of one partition of the model."""
    whole, alpha = back.weights(row["tot"], row["mass"], row["low"].reshape(-1, CUT))
    at = np.flatnonzero(row["hot"] == 1)
    place = np.searchsorted(back.hot[0], row["h"][at])
    whole[at], alpha[at] = back.hot[1][place], back.hot[2][place]
    return row["h"], whole, alpha, (np.repeat(row["h"], row["k"]).astype(np.uint64) << W.U(32)) | row["w"], row["c"]


def _common(model: DataFrame, back: Backoff, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, log10 probabilities) of the most frequent bigrams: as many classes of counts as fit the limit."""

    def of(batch: pa.RecordBatch, k: int) -> dict:
        return {c: np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in _MODEL.items()}

    def size_class(c: np.ndarray) -> np.ndarray:
        return np.floor(8 * np.log2(c)).astype(np.int64)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, n = np.unique(size_class(of(batch, k)["c"]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], names=["size", "n"])

    most = model.mapInArrow(tidied(sizes), "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).collect()
    least, total = None, 0
    for r in sorted(most, key=lambda r: -r.size):
        total += r.n
        if total > limit:
            break
        least = r.size
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = of(batch, k)
                _, whole, _, code, c = _opened(row, back)
                use = size_class(c) >= least
                value = np.log10(np.where(c <= CUT, back.d[np.minimum(c, CUT)], 1.0) * c) - np.repeat(whole, row["k"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[use].view(np.int64)), pa.array(value[use])], names=["code", "value"])

    got = model.drop("stats").mapInArrow(tidied(entries), "code long, value double").toArrow()
    code = got["code"].to_numpy().view(np.uint64)
    order = np.argsort(code)
    return code[order], got["value"].to_numpy()[order]


def _value(code: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probabilities of common bigrams, NaN for others."""
    if not len(common[0]):
        return np.full(len(code), np.nan)
    at = np.minimum(np.searchsorted(common[0], code), len(common[0]) - 1)
    return np.where(common[0][at] == code, common[1][at], np.nan)


def _hot_sums(model: DataFrame) -> DataFrame:
    """(h, tot, mass, n1, ...) of the hot histories, over all partitions."""
    names = [f"n{r}" for r in range(1, CUT + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, hot, tot, mass, low = (np.frombuffer(batch.column(c)[k].as_py(), _MODEL[c])
                                          for c in ("h", "hot", "tot", "mass", "low"))
                use = hot == 1
                low = low.reshape(-1, CUT)[use]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("p")[k:k + 1].take(pa.array(np.zeros(use.sum(), np.int64))), pa.array(h[use].astype(np.int64)),
                     pa.array(tot[use]), pa.array(mass[use]), *[pa.array(low[:, r].copy()) for r in range(CUT)]],
                    names=["p", "h", "tot", "mass", *names])

    rows = model.select("p", "h", "hot", "tot", "mass", "low").mapInArrow(
        tidied(run), "p int, h long, tot long, mass double, " + ", ".join(f"{n} long" for n in names))
    # sums of the sorted list: the same in every run
    mass = F.aggregate(F.array_sort(F.collect_list(F.struct("p", "mass"))), F.lit(0.0), lambda a, x: a + x["mass"])
    return rows.groupBy("h").agg(F.sum("tot").alias("tot"), mass.alias("mass"), *[F.sum(n).alias(n) for n in names])


# ---- 4: scores
_ASKED = {"h": np.uint32, "k": np.uint32, "w": np.uint32, "cw": np.int64, "times": np.uint32}


def _ask(blocks: DataFrame, groups: int, bound: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Bigrams of all texts by partition, but the common ones: for each the texts that hold it.  ``cw`` has the word's
    total only for bigrams that no training text of the block has; ``doc`` takes 2 or 4 bytes a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                _, _, train, size, token, before, number, total = _decoded(batch, b)
                small = np.uint16 if len(size) < 2**16 else np.uint32
                doc = np.repeat(np.arange(len(size), dtype=small), size)
                code = (number[before].astype(W.U) << W.U(32)) | number[token].astype(W.U)
                use = np.flatnonzero((number[before] != NONE) & np.isnan(_value(code, common)))
                p = _home(number[before[use]], number[token[use]], _hot(number, total, bound)[before[use]], groups)
                order = np.lexsort((code[use], p))
                p, use = p[order], use[order]
                code, doc, cw = code[use], doc[use], total[token[use]]
                for a, z in _stretches(p):
                    at = np.flatnonzero(np.concatenate([[True], code[a + 1:z] != code[a:z - 1]]))
                    h = (code[a:z][at] >> W.U(32)).astype(np.int64)
                    own = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    known = np.logical_or.reduceat(train[doc[a:z]], at)
                    yield _batch({
                        "p": pa.array([int(p[a])], pa.int32()), "block": batch.column("block")[b:b + 1],
                        "h": _blob(h[own], np.uint32), "k": _blob(np.diff(np.append(own, len(h))), np.uint32),
                        "w": _blob(code[a:z][at] & W.U(2**32 - 1), np.uint32),
                        "cw": _blob(np.where(known, 0, cw[a:z][at]), np.int64),
                        "times": _blob(np.diff(np.append(at, z - a)), np.uint32), "doc": doc[a:z].tobytes()})

    return blocks.mapInArrow(tidied(run), "p int, block string, " + ", ".join(f"{c} binary" for c in [*_ASKED, "doc"]))


def _answer(asked: pa.Table, model: pa.Table, uni: Unigrams, back: Backoff) -> pa.Table:
    """Sums of log10 probabilities for each text of each block."""
    if model.num_rows:
        mh, whole, alpha, code, mc = _opened({c: x[0] for c, x in zip(_MODEL, _arrays(model, _MODEL), strict=True)}, back)
    else:
        mh, code, mc = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = alpha = np.zeros(0)
    blocks, docs, sums = [], [], []
    for block, doc, h, k, w, cw, times in zip(
            asked["block"].to_pylist(), asked["doc"].to_pylist(), *_arrays(asked, _ASKED), strict=True):
        doc = np.frombuffer(doc, np.uint16 if len(doc) == 2 * int(times.sum()) else np.uint32)
        history = np.searchsorted(mh, h)
        here = np.minimum(history, max(len(mh) - 1, 0))
        own = (mh[here] == h) if len(mh) else np.zeros(len(h), bool)
        # a hot history whose bigrams here are all new
        place = np.minimum(np.searchsorted(back.hot[0], h), max(len(back.hot[0]) - 1, 0))
        lw, la = (np.where(own, x[here], y[place]) if len(back.hot[0]) and len(mh) else x[here] if len(mh) else y[place]
                  for x, y in ((whole, back.hot[1]), (alpha, back.hot[2])))
        lw, la = np.repeat(lw, k), np.repeat(la, k)
        want = (np.repeat(h, k).astype(np.uint64) << W.U(32)) | w
        at = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
        c = np.where(code[at] == want, mc[at], 0) if len(code) else np.zeros(len(want), np.int64)
        seen = np.where(c <= CUT, back.d[np.minimum(c, CUT)], 1.0) * c
        value = np.where(c > 0, np.log10(np.maximum(seen, 1e-300)) - lw, la + np.log10(np.maximum(uni.p(cw), 1e-300)))
        used, local = np.unique(doc, return_inverse=True)
        blocks.append(block)
        docs.append(_blob(used, np.uint32))
        sums.append(_blob(np.bincount(local, weights=np.repeat(value, times)), np.float64))
    return pa.table({"block": pa.array(blocks, pa.string()), "p": pa.array(asked["p"].to_pylist(), pa.int32()),
                     "doc": pa.array(docs, pa.binary()), "value": pa.array(sums, pa.binary())})


_RESULT = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(block: pa.Table, parts: pa.Table, uni: Unigrams, common: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    ids, some, train, size, token, before, number, total = _decoded(block.combine_chunks().to_batches()[0], 0)
    first = np.cumsum(size) - size
    count = total[token]
    known = np.add.reduceat((count > 0).astype(np.int64), first)
    base = np.add.reduceat(uni.base(total)[token], first)
    fresh = number[before] == NONE  # an unseen history leaves the word's own probability
    code = (number[before].astype(W.U) << W.U(32)) | number[token].astype(W.U)
    own = np.where(fresh, np.log10(np.maximum(uni.p(total), 1e-300))[token], np.nan_to_num(_value(code, common)))
    score = np.add.reduceat(own, first)
    parts = parts.sort_by("p")
    for doc, value in zip(*_arrays(parts, {"doc": np.uint32, "value": np.float64}), strict=True):
        score[doc] += value
    return pa.table([pa.array(ids, mask=~some), pa.array(train), pa.array(size), pa.array(known), pa.array(base),
                     pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])


def in_training(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 != 1


def katz_scores(docs: DataFrame, train: F.Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 probability).

    ``train`` tells the rows to learn from; without it, those of :func:`in_training`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(in_training(doc_id) if train is None else train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // DEAL_BYTES)
    raw = _compressed(_blocks(rows))
    words = written(_count_words(raw, groups))
    stats = words.filter("stats is not null").select(*[F.col("stats")[k].alias(f"s{k}") for k in range(CUT + 3)]).agg(
        *[F.coalesce(F.sum(f"s{k}"), F.lit(0)) for k in range(CUT + 3)]).first()
    uni = Unigrams.of(stats[0], stats[1], list(stats[2:]))
    blocks = _compressed(_known(raw, words))
    drop(raw, words)
    if uni.tokens == 0:
        uni = Unigrams(0, 0, uni.d, 1, 1.0)
    bound = uni.tokens // (4 * groups)
    model = _compressed(_model(_train(blocks, groups, bound), uni))
    n = model.select(*[F.col("stats")[k].alias(f"s{k}") for k in range(CUT + 1)]).agg(
        *[F.coalesce(F.sum(f"s{k}"), F.lit(0)) for k in range(CUT + 1)]).first()
    back = Backoff(discounts(list(n)), (np.zeros(0, np.uint32), np.zeros(0), np.zeros(0)))
    hot = _hot_sums(model).orderBy("h").toArrow()
    if hot.num_rows:
        low = np.stack([hot[f"n{r}"].to_numpy() for r in range(1, CUT + 1)], axis=1)
        back.hot = (hot["h"].to_numpy().astype(np.uint32),
                    *back.weights(hot["tot"].to_numpy(), hot["mass"].to_numpy(), low))
    else:  # no training text: the start leaves every word its own probability
        back.hot = (np.array([START], np.uint32), np.zeros(1), np.zeros(1))
    common = _common(model, back, COMMON)
    asked = _ask(blocks, groups, bound, common).groupBy("p").cogroup(model.drop("stats").groupBy("p"))
    parts = written(asked.applyInArrow(
        lambda a, m: _answer(a, m, uni, back), "block string, p int, doc binary, value binary"))
    drop(model)
    return blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(
        lambda b, v: _finish(b, v, uni, common), _RESULT).withColumn("train_tokens", F.lit(uni.tokens).cast("long"))


def _compressed(df: DataFrame) -> DataFrame:
    """Written like :func:`written`, in a form that packs word numbers well."""
    spark = df.sparkSession
    path = new_path(spark)
    with cleaned_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
