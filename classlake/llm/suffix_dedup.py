"""Removal of repeated byte strings with longest-previous-factor arrays.

Every byte of a text that lies in a string of ``length`` bytes which also starts
earlier (in a document with a smaller doc_id, or before in the same one) is removed;
the first occurrence stays.

A suffix array over all texts in one place is out of reach, so the suffixes are
dealt out by content.  A window is a string of ``length`` bytes; its anchor is the
least hash among its ``GRAM``-byte strings, which depends on the window's bytes
alone.  Equal windows have equal anchors at equal places, so only windows under one
anchor must be compared:

1. Consecutive windows of one anchor form a record (about 30 windows), with a hash
   of its context, the bytes that its windows cover.  Within a batch, and then for
   all batches by anchor, a record whose context stands earlier is covered whole.
   Copies, however many, end here: a batch sends one record for each context.
2. Only first records whose anchor has several contexts need bytes.  Their contexts
   are fetched with a join by document and sorted, by anchor, into suffix arrays
   (prefix doubling).  Previous and next smaller positions in suffix order give each
   window's longest previous factor; windows whose factor has ``length`` bytes are covered.
3. An anchor with more than ``HOT`` contexts in one batch (a short line in very many
   documents) is not gathered: its windows become rows of their own, compared with the
   least place of their bytes by an aggregate that combines before it shuffles.
4. Covered windows come together by document and are cut out of the text.

Defined results: a null text is taken as empty; a null doc_id comes before all
others; rows of one doc_id with several texts are documents ordered by a digest of
the text; rows equal in both are one document and each is given that document's
result; texts shorter than ``length`` lose nothing; an empty table gives no rows; no
other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlake.llm import words as W
from classlake.llm.shared import bounded_batches, tidied, written

LENGTH = 100
GRAM = 24
HOT = 256
PIECE = 1 << 20
BATCH_BYTES = 8 << 20      # text of which records are compared before they are dealt out
DEAL_BYTES = 16 << 20     # text behind one group of anchors
ARRAY_BYTES = 1 << 20     # contexts in one suffix array

_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place, by doubling."""
    out, width, base = None, 0, _BASE
    part, size = _BYTE[b], 1
    while True:
        if n & size:  # strings of sizes that add up to n, the smallest first
            if out is None:
                out, width = part, size
            else:
                m = len(b) - width - size + 1
                out = part[width:width + m] + out[:m] * W.U(base)
                width += size
        size *= 2
        if size > n:
            return W.mix(out)
        part = part[:len(part) - size // 2] * W.U(base) + part[size // 2:]
        base = base * base % 2**64


def records(b: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, windows less 1, anchor less first window) of a piece."""
    none = np.zeros(0, W.U), np.zeros(0, W.U), *[np.zeros(0, np.int64)] * 3
    if len(b) < length:
        return none
    h = gram_hashes(b, gram)
    key = (h & W.U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=W.U)
    span, width = length - gram + 1, 1
    low = key
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    anchor = (low & W.U(0xFFFFFF)).astype(np.int32)
    inside = np.zeros(len(anchor) + 1, np.int8)  # windows within one document
    size = np.diff(off)
    ok = size >= length
    np.add.at(inside, off[:-1][ok], 1)
    np.add.at(inside, off[1:][ok] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    power, inverse = W.powers(len(b))
    total = np.zeros(len(b) + 1, W.U)
    np.cumsum(_BYTE[b] * power[:len(b)], out=total[1:])
    context = (total[last + length] - total[first]) * inverse[first]
    context = W.mix(context + W.U(0x632BE59BD9B4E019) * (last - first).astype(W.U))
    at = anchor[first].astype(np.int64)
    # the least hash of a window is small; mixed again, anchors spread evenly over all ranges
    return W.mix(h[at]), context, first, last - first, at - first


_ROW = "p long, ids binary, some binary, ties binary, h binary, c binary, d binary, at binary, more binary, to binary, hot binary"
_KINDS = (("ids", np.int64), ("some", np.uint8), ("ties", np.int64), ("h", np.uint64), ("c", np.uint64), ("d", np.uint32),
          ("at", np.uint32), ("more", np.uint16), ("to", np.uint16), ("hot", np.uint8))
_DEALT = pa.schema([("p", pa.int64()), *[(k, pa.binary()) for k, _ in _KINDS]])

SPAN, ASK, ASK_HOT = 0, 1, 2
_OUT = "kind int, doc_id long, tie long, h long, start long, stop long, anchor long"
_OUT_ARROW = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "tie", "h", "start", "stop", "anchor")]])


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching spans of one document put together."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = doc.astype(np.int64) << 34
    reach = np.maximum.accumulate(shift + stop)
    new = np.concatenate([[True], (shift + start)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.concatenate([at[1:], [len(doc)]]) - 1] - shift[at]


def _groups(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (h, c): first of its (h, c), number of the h group, contexts in each h group."""
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    lead = new_h.copy()
    lead[1:] |= c[1:] != c[:-1]
    group = np.cumsum(new_h) - 1
    return lead, group, np.bincount(group, weights=lead).astype(np.int64)


def _deal(docs: DataFrame, length: int, gram: int, groups: int, hot: int) -> DataFrame:
    """Records of all documents, packed by anchor: p from 0; covered spans and hot requests with p below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy()
            some = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ties = batch.column("tie").to_numpy()
            for i, j in W.runs(off, BATCH_BYTES):
                yield from deal(raw[off[i]:off[j]], off[i:j + 1] - off[i], ids[i:j], some[i:j], ties[i:j])

    def deal(raw, off, ids, some, ties) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ties, ids, some))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found = []
        for i, j in W.runs(off, PIECE):
            whole = int(off[i]), int(off[j])
            # a text longer than a piece is read in pieces that overlap by a window
            starts = range(whole[0], max(whole[1] - length + 1, whole[0] + 1), PIECE) if j == i + 1 else whole[:1]
            for lo in starts:
                hi = min(whole[1], lo + PIECE + length - 1) if j == i + 1 else whole[1]
                part = np.clip(off[i:j + 1], lo, hi) - lo
                h, c, at, more, to = records(raw[lo:hi], part, length, gram)
                d = np.searchsorted(part, at, side="right") - 1
                found.append((h, c, rank[d + i].astype(np.uint32), (at + lo - off[d + i]).astype(np.uint32),
                              more.astype(np.uint16), to.astype(np.uint16)))
        if not found or not sum(len(x[0]) for x in found):
            return
        h, c, d, at, more, to = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        pos = np.lexsort((at, d, c, h))
        h, c, d, at, more, to = h[pos], c[pos], d[pos], at[pos].astype(np.int64), more[pos].astype(np.int64), to[pos]
        lead, group, contexts = _groups(h, c)
        ids, some, ties = ids[order], some[order].astype(np.uint8), ties[order]
        yield from _spans(ids, some, ties, d[~lead], at[~lead], (at + more)[~lead] + length)
        many = contexts > hot
        asked = lead & many[group]
        yield from _asked(ids, some, ties, h[asked], d[asked], at[asked], more[asked], to[asked])
        proxy = np.zeros(len(h), bool)  # one record of a hot anchor tells the others
        proxy[np.searchsorted(group, np.flatnonzero(many))] = True
        send = lead & (~asked | proxy)
        h, c, d, at, more, to = h[send], c[send], d[send], at[send], more[send], to[send]
        flag = proxy[send]
        bounds = np.searchsorted(h, [W.U((k << 64) // groups) for k in range(groups)]).tolist() + [len(h)]
        for p in range(groups):
            a, z = bounds[p], bounds[p + 1]
            if a == z:
                continue
            used, local = np.unique(d[a:z], return_inverse=True)
            cols = (ids[used], some[used], ties[used], h[a:z], c[a:z], local, at[a:z], more[a:z], to[a:z], flag[a:z])
            yield _packed(p, cols)

    return docs.mapInArrow(tidied(run), _ROW)


def _packed(p: int, cols: tuple) -> pa.RecordBatch:
    data = [pa.array([np.ascontiguousarray(x, k).tobytes()], pa.binary()) for x, (_, k) in zip(cols, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *data], schema=_DEALT)


def _spans(ids, some, ties, d, start, stop) -> Iterator[pa.RecordBatch]:
    """Covered spans found within a batch: ``at`` is the start, ``h`` the end."""
    d, start, stop = _merged(d, start, stop)
    if len(d):
        used, local = np.unique(d, return_inverse=True)
        zero = np.zeros(len(d))
        p = -1 - 2 * (int(ids[used[0]]) % 2**40)
        yield _packed(p, (ids[used], some[used], ties[used], stop, zero, local, start, zero, zero, zero))


def _asked(ids, some, ties, h, d, at, more, to) -> Iterator[pa.RecordBatch]:
    if len(h):
        used, local = np.unique(d, return_inverse=True)
        zero = np.zeros(len(d))
        p = -2 - 2 * (int(h[0]) % 2**40)
        yield _packed(p, (ids[used], some[used], ties[used], h, zero, local, at, more, to, zero))


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    """The arrays of all rows of a group, ``d`` pointing into the documents of all."""
    cols = [[np.frombuffer(x, k) for x in table[n].to_pylist()] for n, k in _KINDS]
    base = np.cumsum([0] + [len(x) for x in cols[0][:-1]])
    cols[5] = [x.astype(np.int64) + b for x, b in zip(cols[5], base, strict=True)]
    return [np.concatenate(x) for x in cols]


def _out(kind, ids, some, ties, d, h, start, stop, anchor) -> pa.Table:
    return pa.table([
        pa.array(np.full(len(d), kind, np.int32)), pa.array(ids[d], mask=some[d] == 0), pa.array(ties[d]),
        pa.array(h.view(np.int64)), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64)),
        pa.array(anchor.astype(np.int64))], schema=_OUT_ARROW)


def _settle(table: pa.Table, length: int) -> pa.Table:
    """Records of one range of anchors: spans that are covered, and requests for the contexts to compare."""
    p = table["p"][0].as_py()
    ids, some, ties, h, c, d, at, more, to, hot = _unpacked(table)
    at, more, to = at.astype(np.int64), more.astype(np.int64), to.astype(np.int64)
    if p < 0 and p % 2:
        return _out(SPAN, ids, some, ties, d, np.zeros(len(d), np.int64), at, h, at)
    if p < 0:
        return _out(ASK_HOT, ids, some, ties, d, h, at, at + more + length, at + to)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    alone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (hot[order] == 0)
    pos = order[~alone]
    pos = pos[np.lexsort((at[pos], ties[d[pos]], ids[d[pos]], some[d[pos]], c[pos], h[pos]))]
    h, c, d, at, more, to, hot = h[pos], c[pos], d[pos], at[pos], more[pos], to[pos], hot[pos]
    if not len(h):
        return _OUT_ARROW.empty_table()
    lead, group, contexts = _groups(h, c)
    burning = np.bincount(group, weights=hot) > 0
    ask = lead & ((contexts > 1) | burning)[group]
    # a hot batch's record was asked for already
    ask &= hot == 0
    cover = ~lead
    stop = at + more + length
    parts = [_out(SPAN, ids, some, ties, d[cover], h[cover], at[cover], stop[cover], at[cover]),
             _out(np.where(burning[group[ask]], ASK_HOT, ASK), ids, some, ties, d[ask], h[ask], at[ask], stop[ask],
                  (at + to)[ask])]
    return pa.concat_tables(parts)


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors from a suffix array.

    ``order`` has the positions in suffix order, ``lcp`` the common prefix of each with the one before it.  The nearest
    smaller position on either side shares the most with a suffix among all that start earlier; it is found by
    following, from each suffix, the candidates of its candidate, keeping the least common prefix on the way.  Returned
    in suffix order.
    """
    n = len(order)
    best = np.zeros(n, np.int64)
    for side in (1, -1):
        pos = order[::side]
        # common prefix with the neighbour on this side
        near = np.concatenate([[0], lcp[1:] if side == 1 else lcp[1:][::-1]])
        to, least = np.arange(-1, n - 1), near.astype(np.int64)
        todo = np.arange(n)
        while True:
            todo = todo[(to[todo] >= 0) & (least[todo] > 0)]
            todo = todo[pos[to[todo]] > pos[todo]]
            if not len(todo):
                break
            via = to[todo]
            least[todo] = np.minimum(least[todo], least[via])
            to[todo] = to[via]
        found = np.where(to >= 0, least, 0)
        best = np.maximum(best, found[::side])
    return best


def _ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of the ``size`` bytes from each place) for 8, 16, ... up to the length; ranks keep byte order."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text), W.U)
    for k in range(8):
        word = (word << W.U(8)) | padded[k:len(text) + k]
    out, size = [], 8
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint32)
    while True:
        out.append((size, rank))
        if size * 2 > min(length, len(rank)):
            return out
        word = rank.astype(W.U) << W.U(32)
        word[:len(rank) - size] |= rank[size:]
        rank = np.unique(word, return_inverse=True)[1].astype(np.uint32)
        size *= 2


def covered_windows(contexts: list[bytes], windows: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which windows have an earlier equal one.

    ``contexts[i]`` holds ``windows[i]`` windows from its first byte on; ``place`` gives the order of the contexts'
    first windows in the corpus.  Windows come back context by context.
    """
    size = np.array([len(x) for x in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size
    before = np.cumsum(windows) - windows
    start = np.repeat(begin - before, windows) + np.arange(windows.sum())
    rank_of = np.argsort(place)
    base = np.empty(len(place), np.int64)
    base[rank_of] = np.cumsum(windows[rank_of]) - windows[rank_of]
    # the place of each window in the corpus' order of these contexts
    position = np.repeat(base - before, windows) + np.arange(windows.sum())
    ranks = _ranks(text, length)
    size, rank = ranks[-1]
    order = np.lexsort((position, rank[start + length - size], rank[start]))
    a, b = start[order][:-1], start[order][1:]
    shared = np.zeros(len(a), np.int32)
    for size, rank in reversed(ranks):
        for _ in range(2):  # a size may fit twice
            at = np.minimum(shared, length - size)
            same = (shared + size <= length) & (rank[a + at] == rank[b + at])
            shared += np.where(same, size, 0).astype(np.int32)
    for k in range(8):  # the rest of the length, byte by byte
        at = np.minimum(shared, length - 1)
        shared += (shared < length) & (text[a + at] == text[b + at])
    previous = longest_previous(position[order], np.concatenate([[0], shared]))
    out = np.empty(len(start), bool)
    out[order] = previous >= length
    return out


def _compare(table: pa.Table, length: int) -> pa.Table:
    """Suffix arrays over the contexts of one range of anchors: the spans they show to be covered."""
    ids = table["doc_id"].combine_chunks()
    some, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(-(2**63)).to_numpy()
    ties, start = table["tie"].to_numpy(), table["start"].to_numpy()
    contexts = table["context"].to_pylist()
    windows = np.array([len(c) for c in contexts]) - length + 1
    order = np.lexsort((start, ties, ids, some))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hit = covered_windows(contexts, windows, place, length)
    owner = np.repeat(np.arange(len(contexts)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    d, s, e = _merged(owner[hit], (start[owner] + at)[hit], (start[owner] + at)[hit] + length)
    return pa.table([pa.array(ids[d], mask=~some[d]), pa.array(ties[d]), pa.array(s), pa.array(e)],
                    names=["doc_id", "tie", "start", "stop"])


_SAME = ["doc_id", "tie"]


def _by_document(docs: DataFrame, rows: DataFrame, columns: list[str], name: str, how: str) -> DataFrame:
    """``docs`` with an array of what ``rows`` has of each."""
    got = rows.groupBy(*_SAME).agg(F.collect_list(F.struct(*columns)).alias(name)).select(
        F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), name)
    return docs.join(got, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")), how).drop("_d", "_t")


def _contexts(docs: DataFrame, asks: DataFrame, groups: int) -> DataFrame:
    """(g, doc_id, tie, start, context) for each request; g is the range of its anchor."""
    rows = _by_document(docs, asks, ["h", "start", "stop"], "asks", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            data = raw.tobytes()
            asks = batch.column("asks")
            doc = np.repeat(np.arange(len(off) - 1), asks.value_lengths().to_numpy())
            h, start, stop = (x.to_numpy() for x in asks.flatten().flatten())
            h = h.view(W.U)
            g = ((h >> W.U(32)) * W.U(groups)) >> W.U(32)
            base = off[doc]
            for at in range(0, len(doc), 20_000):
                part = slice(at, at + 20_000)
                pieces = [data[a:b] for a, b in zip((base + start)[part].tolist(), (base + stop)[part].tolist(), strict=True)]
                take = pa.array(doc[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[part].astype(np.int64)), batch.column("doc_id").take(take), batch.column("tie").take(take),
                    pa.array(start[part]), pa.array(pieces, pa.binary())], names=["g", "doc_id", "tie", "start", "context"])

    return rows.select("doc_id", "tie", "text", "asks").mapInArrow(
        tidied(run), "g long, doc_id long, tie long, start long, context binary")


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Covered windows of hot anchors: rows of their own, against the least place of their bytes."""
    windows = contexts.select("doc_id", "tie", "start", "context", F.explode(F.sequence(
        F.lit(0), F.octet_length("context") - length)).alias("k")).select(
        "doc_id", "tie", (F.col("start") + F.col("k")).alias("start"),
        F.sha1(F.substring("context", F.col("k") + 1, F.lit(length))).alias("bytes"))
    place = F.struct("doc_id", "tie", "start")
    first = windows.groupBy("bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return windows.join(first, "bytes").filter(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "tie", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, tie, start, stop): byte spans, overlapping, of ``docs(doc_id, tie, text)`` that repeat earlier ones."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = 1 + size // DEAL_BYTES
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _deal(docs, length, min(gram, length // 2), groups, hot).repartition(max(least, groups), "p")
    settled = written(dealt.groupBy("p").applyInArrow(lambda t: _settle(t, length), _OUT))
    spans = settled.filter(F.col("kind") == SPAN).select(*_SAME, "start", "stop")
    counts = {r.kind: r.n for r in settled.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get(ASK):
        asks = settled.filter(F.col("kind") == ASK)
        arrays = 1 + counts[ASK] * (length + 40) // ARRAY_BYTES
        found = _contexts(docs, asks, arrays).groupBy("g").applyInArrow(
            lambda t: _compare(t, length), "doc_id long, tie long, start long, stop long")
        spans = spans.unionByName(written(found))
    if counts.get(ASK_HOT):
        rows = _contexts(docs, settled.filter(F.col("kind") == ASK_HOT), 1).drop("g")
        spans = spans.unionByName(written(_hot_spans(written(rows), length)))
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document row: doc_id, n_bytes, spans (start and end of each maximal removed run), kept (the other bytes)."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # the digest is needed only where a doc_id stands for several rows
    repeated = not own.groupBy("doc_id").count().filter("count > 1").isEmpty()
    own = own.withColumn("tie", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    spans = repeated_spans(own.dropDuplicates(_SAME) if repeated else own, length, gram, hot)
    rows = _by_document(own, spans, ["start", "stop"], "found", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            found = batch.column("found")
            for i, j in W.runs(off, PIECE):
                yield cut(batch.column("doc_id")[i:j], raw[off[i]:off[j]], off[i:j + 1] - off[i], found[i:j])

    def cut(ids, raw, off, found) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(off) - 1), found.value_lengths().to_numpy())
        d, s, e = _merged(doc, *(x.to_numpy() for x in found.flatten().flatten()))
        change = np.zeros(len(raw) + 1, np.int8)
        np.add.at(change, off[d] + s, 1)
        np.add.at(change, off[d] + e, -1)
        keep = np.cumsum(change[:-1], dtype=np.int8) == 0
        rest = raw[keep].tobytes()
        kept = np.concatenate([[0], np.cumsum(keep)])[off]
        runs = np.searchsorted(d, np.arange(len(off)))
        pair = pa.StructArray.from_arrays([pa.array(s), pa.array(e)], names=["start", "end"])
        return pa.RecordBatch.from_arrays([
            ids, pa.array(np.diff(off)), pa.ListArray.from_arrays(runs.astype(np.int32), pair),
            pa.array([rest[a:b] for a, b in zip(kept[:-1], kept[1:], strict=True)], pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"])

    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return rows.select("doc_id", "text", F.coalesce("found", none).alias("found")).mapInArrow(
        tidied(run), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
