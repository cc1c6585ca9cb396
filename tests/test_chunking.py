"""Chunks of long texts: their lines, and the time they take."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import chunking


def text_of(n, seed=3):
    rnd, out, size = random.Random(seed), [], 0
    while size < n:
        part = " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 25))) + rnd.choice([". ", ".\n", "!\n\n", "?  \n ", "\n"])
        out.append(part)
        size += len(part)
    return "".join(out)[:n]


@pytest.mark.parametrize("overlap", [0, 60])
def test_lines_carried_along_are_those_counted_from_the_start(spark, overlap):
    texts = [text_of(n, n) for n in (0, 5, 399, 401, 3000, 20_000)] + ["\n \n" + text_of(3000, 1) + "\n\n", "漢字。\n" + text_of(900, 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.explode(chunking.windows("t", 400, overlap)).alias("w"), "t")
    told = rows.select("w.before", "w.within", (chunking.line_of("t", F.col("w.low")) - 1).alias("low"), (chunking.line_of("t", F.col("w.high")) - 1).alias("high")).collect()
    assert len(told) > 60 and all((r["before"], r["within"]) == (r["low"], r["high"]) for r in told)


def test_time_grows_with_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([("a", "markdown", text_of(n))], "id string, source_type string, raw_text string")
        began = time.time()
        chunks = chunking.chunk_documents(df).agg(F.count("*"), F.max("span.end")).first()
        assert chunks[0] > n / 1000
        return time.time() - began

    seconds(100_000)
    one, four = min(seconds(1_000_000) for _ in range(2)), min(seconds(4_000_000) for _ in range(2))
    print(one, four)
    assert four < 7 * one + 2
