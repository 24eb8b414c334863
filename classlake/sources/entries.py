"""Input spaces and their entries: archives, directories, single files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class file magic, end-of-archive marker, least length of the record it opens, length of the
# tail in which the record is looked for, suffixes of archives, prefix of versioned entries.
CLASS_MAGIC = bytes.fromhex("CAFEBABE")
ARCHIVE_END = bytes.fromhex("504B0506")
END_RECORD = 22
TAIL = 1024
ARCHIVES = (".jar", ".zip")
VERSIONED = "META-INF/versions/"
BASE_VERSION = -1
LEAST_VERSION = 9

ENTRY_SCHEMA = (
    "unit_id string, kind string, path string, is_dir boolean, magic binary, nested boolean")


def _opens_as_archive(path: str, content: bytes, inside: bool) -> bool:
    """Files of a directory go by their suffix; a file given by itself may also hold an end record."""
    if inside or path.endswith((*ARCHIVES, ".class")):
        return path.endswith(ARCHIVES)
    tail = content[-TAIL:]
    return ARCHIVE_END in tail[:max(0, len(tail) - END_RECORD + len(ARCHIVE_END))]


def _list_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for root, path, content in zip(batch["root"], batch["path"], batch["content"]):
            name = path.rsplit("/", 1)[-1]
            rows = []
            inside = path != root
            if _opens_as_archive(path, content, inside):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            head = b""
                            if not info.is_dir():
                                with archive.open(info) as stream:
                                    head = stream.read(4)
                            rows.append((path, "archive", info.filename, info.is_dir(), head, inside))
                except zipfile.BadZipFile as broken:
                    raise ValueError(f"invalid archive {path}: {broken}") from broken
            elif inside:
                rows.append((root, "directory", path[len(root):].lstrip("/"), False, content[:4], False))
            else:
                rows.append((path, "file", name, False, content[:4], False))
            yield pd.DataFrame(rows, columns=["unit_id", "kind", "path", "is_dir", "magic", "nested"])


def scan_spaces(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a space, one row each, with the first four bytes.

    Files are read in parallel; an archive inside a directory becomes a child
    space of its own (``nested``), an archive inside an archive stays an entry.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "content"))
    bare = path if "://" in path or path.startswith("file:") else path
    root = F.regexp_replace(F.lit(bare), "/+$", "")
    clean = F.regexp_replace("path", "^file:/*", "/")
    spread = files.select(clean.alias("path"), F.regexp_replace(root, "^file:/*", "/").alias("root"), "content")
    return spread.mapInPandas(_list_entries, ENTRY_SCHEMA)


def entry_kind(path: Column, magic: Column, suffix: str = ".class", expected: bytes = CLASS_MAGIC) -> Column:
    """``class`` iff name and magic both say so."""
    return F.when(path.endswith(suffix) & (magic == F.lit(expected)), "class").otherwise("other")


def split_version(df: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """Adds ``base_path`` and ``multirelease``.

    A versioned entry keeps the ``/`` before the rest; without a slash or with
    a malformed number it is a base entry.  Versions below 9 are errors:
    raised when ``strict``, else marked with a null version.
    """
    shape = r"^META-INF/versions/([+-]?[0-9]+)(/.*)$"
    number = F.regexp_extract(path, shape, 1).try_cast("int")
    versioned = number.isNotNull()
    low = versioned & (number < LEAST_VERSION)
    if strict:
        bad = F.raise_error(F.concat(F.lit("version below 9: "), F.col(path))).cast("int")
    else:
        bad = F.lit(None).cast("int")
    return df.withColumn(
        "base_path", F.when(versioned, F.regexp_extract(path, r"(?s)^META-INF/versions/[+-]?[0-9]+(/.*)$", 1)).otherwise(F.col(path))
    ).withColumn("multirelease", F.when(low, bad).when(versioned, number).otherwise(BASE_VERSION))


def base_classes(entries: DataFrame) -> DataFrame:
    return entries.filter((F.col("kind") == "class") & (F.col("multirelease") == BASE_VERSION))


def directories(entries: DataFrame, keys: list[str], path: str, explicit: DataFrame | None = None) -> DataFrame:
    """Distinct proper prefixes of every entry path, without trailing ``/``:
    keys + (dir,).  ``explicit`` adds directory entries as an archive lists them.
    """
    parts = F.split(path, "/")
    upto = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = entries.filter(F.instr(path, "/") > 0).select(*keys, F.explode(upto).alias("dir")).distinct()
    if explicit is not None:
        found = found.unionByName(explicit.select(*keys, F.col("path").alias("dir"))).distinct()
    return found


def precedence(artifacts: DataFrame, key: str = "k") -> DataFrame:
    """One artifact per key: own before library, then the first.

    ``artifacts(key, is_own, ord, ...)``; the aggregate combines before the
    shuffle, so a key with very many copies costs one row per task.
    """
    payload = [c for c in artifacts.columns if c != key]
    rank = F.struct((~F.col("is_own")).alias("lib"), F.col("ord").alias("ord"), F.col("unit").alias("unit"))
    best = artifacts.groupBy(key).agg(F.min_by(F.struct(*payload), rank).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in payload])


def register_misfiled(artifacts: DataFrame, key: str = "k", declared: str = "declared") -> DataFrame:
    """Classes stored under another name also count under their declared name."""
    again = artifacts.filter(F.col(key) != F.col(declared)).withColumn(key, F.col(declared))
    return precedence(artifacts.unionByName(again), key)
