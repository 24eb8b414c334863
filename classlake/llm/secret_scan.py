"""Secrets in whole texts: fixed patterns, and random strings that a token vocabulary packs badly.

Natural words and identifiers take few tokens of a byte-pair vocabulary; random
strings fall apart, so few characters go into each token.  What fixed patterns
cover is cut out; the runs of key-like characters that are left are encoded and
reported if a token holds at most ``ratio`` characters of them on average.  A
run that passes is cut at ``/ + _ -`` into parts, and the stretches of parts that
the vocabulary packs badly are reported, so a key behind a readable path is
found.  Digests, UUIDs and numbers are left out: they are random without being
secret.  A key that follows readable letters without a separator is judged
together with them.

Spans are code points, the end exclusive, sorted by start, then by kind in the
order of ``KINDS``.  Every row is judged for itself, without a shuffle.

Defined results: a null text is taken as empty and has no span; repeated rows
each get their spans; :func:`redact` leaves a null text null; other columns,
whatever their names, are carried along by :func:`redact` and ignored elsewhere.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classlake.llm.shared import bounded_batches, tidied

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so this equals all runs less the short ones
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PART = re.compile(r"[A-Za-z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_RANDOM = 8, 16, 20

#: Lengths of hexadecimal MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
INNER_UUID = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RATIO = 2.0
MASK = "[SECRET]"

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType())]))


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def known(run: str) -> bool:
    """A digest, a UUID, a number, or no letter at all."""
    bare = run.rstrip("=")
    if HEXADECIMAL.fullmatch(bare):
        return len(bare) in DIGESTS or bare.isdigit()
    return bool(UUID.fullmatch(bare)) or not any(c.isalpha() for c in bare)


def _score(part: str, encoding, ratio: float) -> float:
    """Above zero if packed worse than ``ratio``.  Numbers say nothing; words in capitals may pack well in small letters."""
    if part.isdigit():
        return 0
    least = len(encoding.encode_ordinary(part))
    if part.isupper() and part.isalpha():
        least = min(least, len(encoding.encode_ordinary(part.lower())))
    return ratio * least - len(part)


def _stretches(scores: list[float]) -> list[tuple[int, int, float]]:
    """(first, last, sum) of the maximal stretches by score: any longer or shorter one around them has less.

    A stretch is kept with the sums before and after it and the nearest earlier
    one that begins lower, so the pass is linear.
    """
    kept: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for k, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        low, first = before, k
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= total:
                break
            low, first = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((low, total, first, k, j))
    return [(i, k, high - low) for low, high, i, k, _ in kept]


def _bad_stretches(run: str, parts: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(start, end) of stretches of parts that are long enough and packed badly; short ones grow by what costs least."""
    out: list[tuple[int, int]] = []
    for i, k, total in _stretches([p[2] for p in parts]):
        while parts[k][1] - parts[i][0] < LEAST_RANDOM:
            beside = [j for j in (i - 1, k + 1) if 0 <= j < len(parts) and not run[slice(*parts[j][:2])].isdigit()]
            j = max(beside, key=lambda j: parts[j][2], default=None)
            if j is None or total + parts[j][2] < 0:
                break
            i, k, total = min(i, j), max(k, j), total + parts[j][2]
        s, e = parts[i][0], parts[k][1]
        if e - s < LEAST_RANDOM or known(run[s:e]):
            continue
        if out and s <= out[-1][1]:
            s, e = min(s, out[-1][0]), max(e, out.pop()[1])
        out.append((s, e))
    return out


def random_spans(run: str, encoding, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(start, end) of the random strings of one run."""
    if known(run):
        return []
    # tokens do not cross separators, which count neither as tokens nor as characters of a part
    parts = [(m.start(), m.end(), _score(m[0], encoding, ratio)) for m in PART.finditer(run)]
    if sum(p[2] for p in parts) >= 0 or (
            any(c.isdigit() for c in run) and len(run) <= ratio * len(encoding.encode_ordinary(run))):
        return [(0, len(run))]
    ids = [m.span() for m in INNER_UUID.finditer(run)]
    ids = sorted(ids + [p[:2] for p in parts if known(run[p[0]:p[1]]) and not run[p[0]:p[1]].isdigit()])
    out, at, k = [], 0, 0
    for start, end in [*ids, (len(run), len(run))]:
        held = []
        while k < len(parts) and parts[k][0] < max(start, end):
            if at <= parts[k][0] < start:
                held.append(parts[k])
            k += 1
        out += _bad_stretches(run, held)
        at = max(at, end)
    # the last part takes what ends the run
    return [(s, e if PART.search(run, e) else len(run)) for s, e in out]


def spans_of(text: str | None, encoding, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of one text, in order."""
    if not text:
        return []
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    at = 0
    for start, end, _ in [*sorted(found), (len(text), len(text), 0)]:
        for m in RUN.finditer(text, at, max(at, start)):
            found += [(m.start() + s, m.start() + e, 3) for s, e in random_spans(m[0], encoding, ratio)]
        at = max(at, end)
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _scanned(docs: DataFrame, keep: list[str], text: str, vocabulary: str, ratio: float, mask: str | None) -> DataFrame:
    bounded_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                      F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks)
        for batch in batches:
            spans, masked = [], []
            for value in batch.column("text"):
                t = value.as_py()
                own = spans_of(t, encoding, ratio)
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k in own])
                if mask is not None:
                    masked.append(_masked(t, own, mask))
            cols = [batch.column("row"), pa.array(spans, kind)] + ([pa.array(masked, pa.string())] if mask is not None else [])
            yield pa.RecordBatch.from_arrays(cols, names=["row", "spans", "masked"][:len(cols)])

    fields = [out.schema["row"], T.StructField("spans", SPANS)]
    return out.mapInArrow(tidied(run), T.StructType(fields + [T.StructField("masked", T.StringType())] * (mask is not None)))


def _masked(text: str | None, spans: list[tuple[int, int, str]], mask: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 ratio: float = RATIO) -> DataFrame:
    """Per document row: doc_id, spans (kind, start, end)."""
    return _scanned(docs, [doc_id], text, vocabulary, ratio, None).select(
        F.col(f"row.`{doc_id}`").alias("doc_id"), "spans")


def redact(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO,
           mask: str = MASK) -> DataFrame:
    """All rows and columns of ``docs``; each stretch of overlapping secrets in the text is replaced by ``mask``."""
    out = _scanned(docs, docs.columns, text, vocabulary, ratio, mask)
    return out.select(*[F.col("masked").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
