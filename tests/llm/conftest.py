import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Empty and blank, long, tied, repeated and null.
ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two",
    "One TWO three",
    "one two three",
    "  double  spaces \n and lines\n\nhere ",
    "naïve Ünïcode — “quotes” … 日本語 テキスト ΣΑΣ Σ İ",
    "🙂🙂 emoji é combining",
    "<|endoftext|> and <|startoftext|>x<|endoftext|",
    "a" * 3000,
    "x y " * 4000,
    "'s 't it's we'll I'd ’s ½ ² 12345 ___ \x1c\x85 　 end",
    "the same words over and over again, " * 30,
    "the same words over and over again, " * 30,
    "before it " + "the same words over and over again, " * 30 + " and behind",
]


@pytest.fixture()
def odd(spark):
    """Odd texts, with a null id, a repeated row, and columns that operators might use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a text without an id"), (6, "one two three")]
    columns = "doc_id long, text string, part int, block int, n long, key string, data string, row int, fingerprint int"
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], columns)


@pytest.fixture()
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
