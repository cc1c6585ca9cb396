"""Small awkward tables for all operators, and plain-Python forms of what they shall return."""

from __future__ import annotations

import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, _key int, bucket int, signature string, fold int, level int, part string, number int, row string"

LONG = " ".join(f"wort{i % 977} straße{i % 31}" for i in range(9000))
BASE = "the quick brown fox jumps over the lazy dog while seven other animals watch from the old wooden fence and wonder about it all day long"
NEAR = BASE.replace("seven", "eight")
TEXTS = [None, "", "   \t\n ", "one two", "one two", BASE, BASE, NEAR, BASE.upper(), LONG, LONG + " end", "Ünïcödé <|endoftext|> ñandú 漢字 🙂", "a\\b<|c", "x" * 5000]


def docs(spark, texts=TEXTS, ids=None):
    """documents with extra columns whose names the operators use inside, a repeated row and a null id."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if n % 5 == 4 else "en", None if n % 4 == 3 else f"s{n % 3}", len(t or ""), "x", "y", 1, 2, "z", 3, 4, "p", 5, "r") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    out = docs(spark)
    return out.unionByName(out.where("doc_id IN (5, 9)")).unionByName(docs(spark, ["no id here at all today", None], [None, None]))


def empty(spark):
    return docs(spark, [], [])


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts
