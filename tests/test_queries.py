import hashlib
import random
import re
from html import unescape

import pytest

import __spark_entry__ as entry
from loomgraph.operators import resolve
from loomgraph.sources import loaders
from tests.conftest import SF
from tests.oracle import connection, rows_of, sql_rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(duck, SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "score", "via", "rank"] and df.count() == 240


def test_results_do_not_depend_on_partitions(spark):
    names = ("hybrid_search", "er_plan", "rescore")
    base = {n: rows_of(QUERIES[n](spark, SF)) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {n: rows_of(QUERIES[n](spark, SF)) for n in names} == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_web_docs_by_plain_python(spark):
    pages = {r["url"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["web_docs"](spark, SF).collect()
    assert sorted(r["uri"] for r in rows) == sorted(pages)
    for r in rows:
        html = pages[r["uri"]]
        text = loaders.readable(html)["text"]
        assert (r["n_chars"], r["digest"]) == (len(text), hashlib.md5(text.encode()).hexdigest())
        # title and words without the tree: what stands in scripts, styles, navigation, headers and footers is left out
        title = re.search(r"<title>([^<]*)</title>", html)
        assert r["title"] == (unescape(title[1]).strip() if title and title[1].strip() else r["uri"])
        open_ = re.sub(r"(?s)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ", html)
        words = set(re.findall(r"\w+", unescape(re.sub(r"<[^>]*>", " ", open_))))
        assert set(re.findall(r"\w+", text)) <= words and r["n_links"] <= len(re.findall(r"href=.http", open_))


def test_similar_names_meet_by_parts(spark):
    """Candidate pairs against all pairs, for names of many lengths; no plan joins on the label alone."""
    rng = random.Random(5)
    names = {"".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 12]))) for _ in range(150)}
    names |= {"".join(rng.choice(["lamp", "post", "tide", "buoy", "s"]) for _ in range(rng.randrange(2, 14))) for _ in range(150)}
    rows = [(n, "xy"[i % 2], i, 1) for i, n in enumerate(sorted(names))]
    found = resolve.candidates(spark.createDataFrame(rows, "name string, label string, ord long, mention_count long"))
    got = {(r["a_name"], r["b_name"]): r["distance"] for r in found.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    expected = {}
    for i, (a, la, *_) in enumerate(rows):
        for b, lb, *_ in rows[i + 1 :]:
            if la == lb and ((d := distance(a, b)) <= 2 or 1 - d / max(len(a), len(b), 1) >= 0.86):
                expected[a, b] = d
    assert got == expected
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and all("key#" in j for j in re.findall(r"Join \[[^\]]*label#[^\]]*\]", plan) if "fx#" not in j and "fy#" not in j)


def test_plans(spark):
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("fulltext_topk")
    assert not any(x in plan(n) for x in ("Cartesian", "NestedLoop") for n in ("er_candidates", "match_entities"))
    # normalize_text asks Python for NFC, so chunk_windows and md_sections, which start with it, are not among these
    for n in ("fulltext_topk", "bm25_topk", "kg_extract", "khop_expand", "er_candidates", "transcript_turns", "chunk_positions", "md_links"):
        assert "Python" not in plan(n) and "Arrow" not in plan(n), n
