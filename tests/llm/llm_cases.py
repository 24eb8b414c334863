import re

import pytest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile("[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOWER))


@pytest.fixture
def frame(spark):
    """Documents with the columns of the given table, some of them with names that results use as well."""

    def make(rows, extra=True):
        cols = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, *(list(more) + ["en", "src0", 0][len(more):])) for i, t, *more in rows]
        if not extra:
            return spark.createDataFrame(full, cols)
        names = "row string, spans long, n_links long, tokens long, p int, key string, block string"
        return spark.createDataFrame(
            [(*r, "x", 1, 2, 3, 4, "k", "b") for r in full], f"{cols}, {names}")

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
