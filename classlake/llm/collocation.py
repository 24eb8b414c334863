"""Frequent phrases by Toivonen's method, and their scores as collocations.

A phrase is 1 to ``LONGEST`` words in a row within a piece of a text; everything is
counted for each language by itself.

1. A sample of whole documents, chosen by a hash of doc_id, proposes phrases: those
   with at least ``sample_least`` occurrences in it.  Parts of a proposed phrase are
   proposed too.  Proposals are kept as bits of a table of fixed size, at the place that
   a phrase's hash names; a chance hit only has a phrase counted that need not be.
2. The full pass counts, over all documents, every word and every phrase whose first
   and last words but one are proposed: the proposals and their negative border, which
   is never listed.  Counts are added up by 64-bit hash; a hash has at least the count of
   each phrase under it.
3. A phrase of the border with enough occurrences is a failure: phrases around it have
   not been counted.  Failures are added to the proposals and another full pass counts
   what that opens, until none fails.  Each phrase is counted whole in one pass.  As
   words are all counted, there are at most ``LONGEST`` passes.
4. The phrases under a hash with enough occurrences are counted once more, by
   themselves: what was found is exact, whatever hashes did.

A task adds its counts up before they are dealt out.

Defined results: a null text is empty; a null language is ``und``; repeated rows count
each time; the sample of a null doc_id is that of 0 and changes no result; other columns
are ignored; an empty table, or one without a frequent phrase, gives no rows.  A text is
read in blocks that end with a piece, so memory follows the longest piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classlake.llm import words as W
from classlake.llm.shared import bounded_batches, cleaned_shuffles, drop, tidied, written

LONGEST = 4
LEAST = 30
SAMPLE, SAMPLE_LEAST = 8, 2  # one document in so many, and what a phrase needs there
BITS = 26                    # the table of proposals has 2 ** BITS bits, whatever the input
COVERED = (100, 80)          # dropped inside a longer phrase if 100 * longer >= 80 * own
TOP = 2000
BLOCK_BYTES = 2 << 20
HELD = 3 << 20               # rows that a task adds up before it lets them go
LENGTH = W.U(15)             # bits of a hash that hold the phrase's number of words

#: What a byte is: part of a word, a blank between words, or the end of a piece.
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.array([BREAK if c in b".,;:!?\n\v\f\r" else BLANK if c in b" \t" else WORD for c in range(256)], np.uint8)
_VALUES = np.random.default_rng(12).integers(1, 2**63, (2, 256), dtype=np.uint64) | W.U(1)
_PLACE = np.random.default_rng(34).integers(1, 2**63, 16, dtype=np.uint64) | W.U(1)


@dataclass
class Words:
    """Words of some pieces: ``text`` holds them with one blank behind each."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    joined: np.ndarray  # the word goes on with the piece of the word before
    lang: np.ndarray
    hash: np.ndarray    # two rows

    def grams(self, k: int, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Two hashes of the phrases of k words that begin at the words ``at``, with k in the last bits."""
        value = seeds[self.lang[at]] * _PLACE[-1]
        out = np.stack([value, value ^ _PLACE[-1]])
        for j in range(k):
            out += self.hash[:, at + j] * _PLACE[j]
        return W.mix(out) & ~LENGTH | W.U(k)

    def phrases(self, k: np.ndarray, at: np.ndarray) -> pa.Array:
        last = at + k - 1
        size = self.start[last] + self.size[last] - self.start[at]
        off = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        data = self.text[np.repeat(self.start[at] - off[:-1], size) + np.arange(off[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty((2, len(start)), W.U)
    for i, j in W.runs(np.append(start, len(text)), W.BLOCK):
        part = text[start[i]:start[j - 1] + size[j - 1]]
        s = start[i:j] - start[i]
        e = s + size[i:j]
        power, inverse = W.powers(len(part))
        for row, values in zip(out, _VALUES, strict=True):
            total = np.zeros(len(part) + 1, W.U)
            np.cumsum(values[part] * power[:len(part)], out=total[1:])
            row[i:j] = W.mix((total[e] - total[s]) * inverse[s] + size[i:j].astype(W.U))
    return out


def blocks(raw: np.ndarray, off: np.ndarray, lang: np.ndarray) -> Iterator[Words]:
    """Words of texts that each end with a break; ``lang`` is a number for each text."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        ends = np.flatnonzero(KIND[raw[at:end]] == BREAK)
        while not len(ends):
            here, end = end, min(n, end + BLOCK_BYTES)
            ends = np.flatnonzero(KIND[raw[here:end]] == BREAK) + (here - at)
        end = at + int(ends[-1]) + 1
        part = W.LOWER[raw[at:end]]
        kind = KIND[part]
        inside = kind == WORD
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        s, e = edge[::2], edge[1::2]
        if len(s):
            breaks = np.cumsum(kind == BREAK)
            joined = np.zeros(len(s), bool)
            joined[1:] = breaks[s[1:]] == breaks[e[:-1] - 1]
            inside[e] = True
            part[e] = 32
            size = e - s
            start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
            text = part[inside]
            doc = np.searchsorted(off[1:], s + at, side="right")
            yield Words(text, start, size, joined, lang[doc], _hashes(text, start, size))
        at = end


class Proposals:
    """Set of phrase hashes as bits of a table of fixed size."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.shift = W.U(64 - bits)
        self.table = np.zeros(max(1, 2**bits // 64), W.U) if table is None else table

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> self.shift
        return (self.table[bit >> W.U(6)] >> (bit & W.U(63))) & W.U(1) == 1

    def with_hashes(self, hashes: DataFrame) -> Proposals:
        """Also those of the column ``g``; at most one row for each 64 bits reaches the driver."""
        bit = F.expr(f"shiftrightunsigned(g, {int(self.shift)})")
        rows = hashes.select(bit.alias("bit")).select(
            F.shiftright("bit", 6).alias("place"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
        with cleaned_shuffles(hashes.sparkSession):
            got = rows.groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
        table = self.table.copy()
        place = got["place"].to_numpy()
        table[place] |= got["mask"].to_numpy().view(W.U)
        return Proposals(int(64 - int(self.shift)), table)


def opened(words: Words, seeds: np.ndarray, new: Proposals | None, old: Proposals | None,
           longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, hashes) of the phrases that ``new`` has counted and ``old`` has not; without ``new``, of all."""
    n = len(words.start)
    at, run = np.arange(n), np.ones(n, bool)
    in_new = in_old = None
    for k in range(1, longest + 1):
        if k > 1:
            run = run[:-1] & words.joined[k - 1:]
            m = len(run)
            at = np.flatnonzero(run & in_new[:m] & in_new[1:m + 1])
            before = in_old[at] & in_old[at + 1] if old else None
        else:
            before = np.ones(n, bool) if old else None
        grams = words.grams(k, at, seeds)
        fresh = ~before if old else slice(None)
        yield k, at[fresh], grams[:, fresh]
        if k < longest:
            in_new = np.zeros(n + 1, bool)
            in_new[at] = new.holds(grams[0]) if new else True
            if old:
                in_old = np.zeros(n + 1, bool)
                in_old[at[before]] = old.holds(grams[0][before])


def _distinct(h: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each column of hashes, sum of n); ``h`` has one row or two."""
    if not h.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h[0])
    for last in (False, True):
        new = np.ones(len(order), bool)
        np.not_equal(h[0][order[1:]], h[0][order[:-1]], out=new[1:])
        other = h[-1][order[1:]] != h[-1][order[:-1]]
        if last:
            new[1:] |= other
        elif (other & ~new[1:]).any():  # two phrases under one hash
            order = np.lexsort((h[-1], h[0]))
            continue
        break
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)
    return order[first], total


class Tally:
    """Counts of a task, added up block by block; at most ``HELD`` rows and a block's are held."""

    def __init__(self, key: str | None = None):
        self.key = key  # name of a column that takes the first hash
        self.parts: list[tuple[np.ndarray, pa.Table]] = []
        self.rows = self.merged = 0

    def add(self, hashes: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """``hashes`` tell the rows of ``table`` apart, whose column n is added up."""
        self.parts.append((hashes, table))
        self.rows += table.num_rows
        if self.rows > max(HELD // 4, 2 * self.merged):  # what was added up doubled
            self.merge()
            if self.merged > HELD // 2:
                yield from self.let_go()

    def merge(self) -> None:
        if len(self.parts) > 1:
            h = np.concatenate([p[0] for p in self.parts], axis=1)
            table = pa.concat_tables([p[1] for p in self.parts])
            self.parts = []
            at, total = _distinct(h, table["n"].to_numpy())
            names = [c for c in table.column_names if c != "n"]
            table = pa.table([*(table[c].take(pa.array(at)) for c in names), total], names=[*names, "n"])
            self.parts, self.rows = [(h[:, at], table)], len(at)
        self.merged = self.rows

    def let_go(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for h, table in self.parts:
            for batch in table.combine_chunks().to_batches(max_chunksize=1 << 17):
                if self.key:
                    key, h = pa.array(h[0][:batch.num_rows].view(np.int64)), h[:, batch.num_rows:]
                    batch = pa.RecordBatch.from_arrays([key, *batch.columns], names=[self.key, *batch.schema.names])
                yield batch
        self.parts, self.rows, self.merged = [], 0, 0


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in names], W.U)


def _read(batch: pa.RecordBatch) -> tuple[list[str], Iterator[Words]]:
    raw, off = W.texts(batch.column("text"))
    lang = batch.column("lang").dictionary_encode()
    return lang.dictionary.to_pylist(), blocks(raw, off, lang.indices.to_numpy())


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text): texts end with a break, nothing is null but doc_id."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n")).alias("text"))


def _hashes_counted(docs: DataFrame, new, old, lengths: range, least: int) -> DataFrame:
    """(g): hashes with ``least`` occurrences of phrases of these lengths that ``new`` opens and ``old`` does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally("g")
        known, before = new.value if new else None, old.value if old else None
        for batch in batches:
            names, found = _read(batch)
            seeds = _seeds(names)
            for words in found:
                g = np.concatenate([g[:1] for k, _, g in opened(words, seeds, known, before, lengths[-1]) if k in lengths], axis=1)
                at, n = _distinct(g, None)
                yield from tally.add(g[:, at], pa.table({"n": n}))
        yield from tally.let_go()

    # tasks have added up what they can, so rows are dealt out as they are
    return (docs.select("lang", "text").mapInArrow(tidied(run), "g long, n long").repartition("g")
            .groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("g"))


def _phrases_counted(docs: DataFrame, chosen, least: int, longest: int) -> DataFrame:
    """(lang, k, phrase, n): phrases under the ``chosen`` hashes with ``least`` occurrences; k = 0 holds a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, known = Tally(), chosen.value
        for batch in batches:
            names, found = _read(batch)
            seeds, langs = _seeds(names), pa.array(names, pa.string())
            for words in found:
                some = [(k, at[held], g[:, held]) for k, at, g in opened(words, seeds, known, None, longest)
                        for held in [known.holds(g[0])]]
                h = np.concatenate([g for _, _, g in some], axis=1)
                k = np.repeat([k for k, _, _ in some], [len(at) for _, at, _ in some])
                start = np.concatenate([at for _, at, _ in some])
                at, n = _distinct(h, None)
                k, start = k[at], start[at]
                yield from tally.add(h[:, at], pa.table({
                    "lang": langs.take(pa.array(words.lang[start])), "k": pa.array(k, pa.int32()),
                    "phrase": words.phrases(k, start).cast(pa.string()), "n": n}))
                total = np.bincount(words.lang, minlength=len(names))
                here = np.flatnonzero(total)
                yield from tally.add(np.stack([seeds[here] & ~LENGTH, seeds[here]]), pa.table({
                    "lang": langs.take(pa.array(here)), "k": pa.array(np.zeros(len(here)), pa.int32()),
                    "phrase": pa.array([""] * len(here)), "n": total[here].astype(np.int64)}))
        yield from tally.let_go()

    return (docs.select("lang", "text").mapInArrow(tidied(run), "lang string, k int, phrase string, n long")
            .groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("k") == 0)))


def _failures(found: DataFrame, known, longest: int) -> DataFrame:
    """(g): those of ``found`` that were not proposed and may have longer phrases around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("g").to_numpy().view(W.U)
            g = g[((g & LENGTH) < W.U(longest)) & ~known.value.holds(g)]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["g"])

    return found.mapInArrow(tidied(run), "g long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE,
                     sample_least: int = SAMPLE_LEAST, bits: int = BITS) -> DataFrame:
    """(lang, k, phrase, n): all phrases of k <= ``longest`` words with ``least`` occurrences; k = 0 has all words' sum."""
    if not 1 <= longest < 16:
        raise ValueError("phrases have 1 to 15 words")
    share = docs.sparkSession.sparkContext.broadcast  # of tables with 2 ** bits bits
    docs = prepared(docs)
    chosen = docs.filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(sample)) == 0)
    # what is proposed only has to tell which longer phrases to count
    held = Proposals(bits).with_hashes(_hashes_counted(chosen, None, None, range(1, min(2, longest) + 1), sample_least))
    for k in range(3, longest):
        held = held.with_hashes(_hashes_counted(chosen, share(held), None, range(k, k + 1), sample_least))
    old, frequent = None, Proposals(bits)
    while True:
        new = share(held)
        found = written(_hashes_counted(docs, new, old, range(1, longest + 1), least))
        frequent = frequent.with_hashes(found)
        failed = written(_failures(found, new, longest))
        closed = failed.isEmpty()
        if not closed:
            old, held = new, held.with_hashes(failed)
        drop(found, failed)
        if closed:
            return written(_phrases_counted(docs, share(frequent), least, longest))


def _over(phrase: str, first, size) -> F.Column:
    return F.array_join(F.slice(phrase, first, size), " ")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the best ``top`` phrases of each language."""
    phrases = frequent_phrases(docs, least, longest, **options)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    part = phrases.filter(F.col("k").between(1, longest - 1))
    cand = phrases.filter("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "k", "phrase", "a", "cut", _over("w", F.lit(1), F.col("cut")).alias("left"),
        _over("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    scored = (
        cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        .join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        .withColumn("twice", (wide("l") + wide("r")))
        .withColumn("big", F.lit(2000000).cast("decimal(10,0)") * wide("a"))
        .withColumn("score", F.expr("big div twice"))
        .groupBy("lang", "k", "phrase").agg(
            F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    # the most frequent longer candidate around each phrase
    inner = cand.filter("k >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn(
        "first", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    around = inner.groupBy("lang", _over("w", F.col("first"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    whole, share = COVERED
    kept = scored.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (wide("longer") * F.lit(whole) < wide("a") * F.lit(share)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"),
                       F.col("best.score").cast("long").alias("score"), F.col("best.cut").alias("cut"),
                       F.pmod(F.xxhash64("phrase"), F.lit(256)).alias("part"))
    # the best of a language are among the best of its parts, so no part of it is sorted whole
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(
        F.col("rank") <= top).drop("part", "rank")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top)
    words = phrases.filter("k = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
