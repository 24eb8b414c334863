"""Language of whole texts in two steps: the family first, then the languages within it.

Features are hashed byte trigrams of the lower-cased text, letters and blanks
only, as square roots of their shares.  A linear support vector machine for each
family against the rest picks the family; within a family one machine for each
pair of languages votes.

Models are fitted on the driver from at most ``per_language`` labelled texts of
each language (and a passage of each), chosen by a hash of doc_id; the
prediction reads the text alone, of every row, without a shuffle.

Defined results: a null text, and a text without a letter, is ``und`` with score
0; without any labelled row all texts are ``und``; with one language every text
with a letter gets it; a null doc_id counts as '' in the hold-out rule; repeated
rows are judged each for itself; ties go to the first family or language in
alphabetical order; extra columns are carried along by :func:`keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classlake.llm import words as W
from classlake.llm.shared import bounded_batches, tidied

UND = "und"
FEATURES = 4096
PER_LANGUAGE = 500
PIECE = 2 << 20

#: Families of closely related languages by code. Any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}

_PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), code)


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One unit-length row for each text."""
    n = len(off) - 1
    if len(raw) < 3:
        return np.zeros((n, FEATURES), np.float32)
    b = _PLAIN[raw].astype(np.uint32)
    code = (b[:-2] * np.uint32(0x01000193) + b[1:-1]) * np.uint32(0x01000193) + b[2:]
    blank = (b[:-2] == 32) & (b[1:-1] == 32) & (b[2:] == 32)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
    doc = np.repeat(np.arange(n), np.diff(off))
    whole = (doc[:-2] == doc[2:]) & ~blank
    count = np.bincount(doc[:-2][whole] * FEATURES + code[whole], minlength=n * FEATURES)
    out = np.sqrt(count.reshape(n, FEATURES).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _machine(x: np.ndarray, y: np.ndarray, seed: int, passes: int = 15, rate: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear support vector machine: averaged stochastic subgradient of the hinge loss."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w, total, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    rng = np.random.default_rng(seed)
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            t += 1
            step = 1 / (rate * (t + 1 / rate))
            if y[i] * (w @ x[i]) < 1:
                w += step * share[y[i]] * y[i] * x[i]
            w *= 1 - step * rate
        total += w
    return total / passes


@dataclass
class Model:
    """``family_weights`` has a column for each family; ``pairs`` has (i, j, weights), i < j in ``languages``."""

    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``languages``, score) of each row."""
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        of = np.array([self.families.index(family(lang)) for lang in self.languages])
        margin = x @ self.family_weights
        chosen = margin.argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * np.clip(margin.max(axis=1), -20, 20)))
        votes = np.zeros((len(x), len(self.languages)))
        for i, j, w in self.pairs:
            m = x @ w
            first = 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
            votes[:, i] += (m >= 0) + first / 1e3
            votes[:, j] += (m < 0) + (1 - first) / 1e3
        votes[of[None, :] != chosen[:, None]] = -1
        best = votes.argmax(axis=1)
        rivals = np.bincount(of, minlength=len(self.families))[chosen] - 1
        share = np.where(rivals > 0, np.clip(votes[np.arange(len(x)), best], 0, None) / np.maximum(rivals * 1.001, 1), 1)
        return best, np.clip(sure * share, 0, 1)


def train(x: np.ndarray, lang: list[str]) -> Model:
    names = sorted(set(lang))
    groups = sorted({family(n) for n in names})
    y = np.array([names.index(v) for v in lang])
    f = np.array([groups.index(family(v)) for v in lang])
    weights = np.zeros((x.shape[1] + 1, len(groups)))
    if len(groups) > 1:
        for k in range(len(groups)):
            weights[:, k] = _machine(x, np.where(f == k, 1, -1), k)
    else:
        weights[-1] = 10
    pairs = []
    for i, j in combinations(range(len(names)), 2):
        if family(names[i]) == family(names[j]):
            own = (y == i) | (y == j)
            pairs.append((i, j, _machine(x[own], np.where(y[own] == i, 1, -1), 100 * i + j)))
    return Model(names, groups, weights, pairs)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """Model from at most about ``per_language`` texts of each language, none of them held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)).alias("h"), held_out(doc_id).alias("out"),
    ).filter("lang is not null and text is not null and not out")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model()
    # a hash bound for each language keeps the expected number at the bound, with no sort
    bound = F.lit(0)
    for name, n in counts.items():
        bound = F.when(F.col("lang") == name, int((1 << 30) * min(1.0, per_language / n))).otherwise(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            for i, j in W.runs(off, PIECE):
                part = raw[off[i]:off[j]]
                o = off[i:j + 1] - off[i]
                whole = features(part, o)
                size = np.diff(o)
                begin = o[:-1] + size // 3  # a passage, so that short texts are met as well
                ends = np.minimum(begin + 200, o[1:])
                passages = [part[a:b] for a, b in zip(begin, ends, strict=True)]
                short = features(np.concatenate(passages), np.concatenate([[0], np.cumsum(ends - begin)]))
                both = (np.stack([whole, short], axis=1) * 255).round().astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang")[i:j], pa.array([r.tobytes() for r in both], pa.binary())],
                    names=["lang", "x"])

    got = rows.filter(F.col("h") < bound).select("lang", "text").mapInArrow(tidied(run), "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint8).reshape(-1, FEATURES).astype(np.float32)
    names = np.repeat(got["lang"].to_pylist(), 2).tolist()
    if not names:  # the bound left none of a tiny table
        return Model()
    order = np.lexsort((*x[:, :8].T, names))
    x = x[order] / np.maximum(np.linalg.norm(x[order], axis=1, keepdims=True), 1e-6)
    return train(x, [names[i] for i in order])


def _letters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    total = np.concatenate([[0], np.cumsum((_PLAIN[raw] != 32) & (raw < 128))])
    out = total[off[1:]] > total[off[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in raw[off[d]:off[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _identified(docs: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    bounded_batches(docs.sparkSession)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                      F.col(text).cast("string").alias("text"))
    schema = T.StructType([out.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UND], object)
        for batch in batches:
            raw, off = W.texts(batch.column("text"))
            pred, score = np.full(len(off) - 1, len(model.languages)), np.zeros(len(off) - 1)
            for i, j in W.runs(off, PIECE) if model.languages else ():
                part, o = raw[off[i]:off[j]], off[i:j + 1] - off[i]
                some = _letters(part, o)
                best, sure = model.predict(features(part, o))
                pred[i:j] = np.where(some, best, len(model.languages))
                score[i:j] = np.where(some, sure, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names[pred], pa.string()), pa.array(score)],
                names=["row", "lang_pred", "score"])

    return out.mapInArrow(tidied(run), schema)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score."""
    return _identified(docs, [doc_id], text, model).select(
        F.col(f"row.`{doc_id}`").alias("doc_id"), "lang_pred", "score").select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is told; a null language takes the predicted one."""
    out = _identified(docs, docs.columns, text, model).filter(F.col("lang_pred") != UND)
    return out.select(*[
        F.coalesce(F.col(f"row.`{c}`"), F.col("lang_pred")).alias(c) if c == lang else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns])
