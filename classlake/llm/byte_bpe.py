"""Byte-level BPE with a rank file: texts to token ids and back to bytes.

The tiktoken library encodes; its rank file is read from a path that every
executor has.  A long text is cut first, at places where the split pattern ends a
match whatever follows: between a visible character and white space, behind an
ASCII letter or digit that punctuation follows, and between a Chinese character
and full-width punctuation.  No match of the pattern begins before such a place
and ends behind it, so the pieces' ids joined are the text's ids, and a task holds
the Python integers of one piece at a time.  A match is never cut, however long.

Decoding looks the ids' bytes up in an Arrow array and joins them; it needs no
valid UTF-8 in between, so tokens that hold part of a character are no matter.

Every row is worked on for itself, without a shuffle; columns travel along.

Defined results: a null text is empty and has no ids; bytes that are no UTF-8
become U+FFFD, as the library takes characters only; text that looks like a
special token is ordinary text; null ids decode to no bytes, and so do ids that
the vocabulary lacks; repeated rows stay rows of their own; an existing column with
the name of the result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from classlake.llm.shared import bounded_batches, tidied

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 17  # characters after which a text is cut at the next safe place
SAFE = re.compile(
    r"(?<=\S)(?=[ \t\r\n])"
    r"|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])"
    "|(?<=[一-龥])(?=[、。，！？])")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks by token bytes of a tiktoken file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """Bytes of each id; null where the file has no such id."""
    ranks = vocabulary(path)
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters (but the last), cut at safe places only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def text_ids(text: str, path: str = VOCABULARY, pattern: str = SPLIT, size: int = PIECE) -> np.ndarray:
    own = encoding(path, pattern)
    found = [np.array(own.encode_ordinary(p), np.int32) for p in pieces(text, size)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def _added(df: DataFrame, source: str, out: str, kind: T.DataType, column) -> DataFrame:
    """``df`` with ``out`` = ``column`` of each batch's ``source``, in place of a column of that name."""
    bounded_batches(df.sparkSession)
    names = [n for n in df.columns if n != out]
    here = [*range(len(names)), names.index(source) if source in names else len(names)]
    if here[-1] == len(names):  # the result replaces its own source
        df = df.select(*names, source)
    else:
        df = df.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = column(batch.column(here[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], made], names=[*names, out])

    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(out, kind)])
    return df.mapInArrow(tidied(run), schema)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY,
           pattern: str = SPLIT) -> DataFrame:
    """``df`` with the token ids of each text as ``out``, array<int>."""

    def column(texts: pa.Array) -> pa.Array:
        ids, off = [np.zeros(0, np.int32)], [0]
        for raw in texts.cast(pa.binary()):
            found = text_ids((raw.as_py() or b"").decode("utf-8", "replace"), path, pattern)
            ids.append(found)
            off.append(off[-1] + len(found))
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(ids)))

    return _added(df, text, out, T.ArrayType(T.IntegerType()), column)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for as ``out``, binary."""

    def column(lists: pa.Array) -> pa.Array:
        tokens = token_bytes(path)
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        off = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(off[0], off[-1] - off[0])
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
        joined = tokens.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
        ends = joined.buffers()[1]
        at = np.frombuffer(ends, np.int64)[joined.offset:joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        data = joined.buffers()[2] if len(joined) else None
        made = pa.Array.from_buffers(pa.large_binary(), len(lists), [
            None, pa.py_buffer(np.ascontiguousarray(at[off - off[0]])), data if data is not None else pa.py_buffer(b"")])
        return made.cast(pa.binary())

    return _added(df, ids, out, T.BinaryType(), column)
