"""Match expressions against SQLite's full-text search, which defines them."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from paperloom.operators import search

COLUMNS = search.INDEXED
FIXED = [
    "NEAR(a b c, 1)", "NEAR(a b, 0)", "NEAR(a b)", 'NEAR("a b" c, 2)', "NEAR(a a, 3)", "NEAR(a)", "^a", "^ a + b", "{title text} : a", "- title : a",
    "-{title text}:a", "title : (a OR b)", "- text : (a AND b) NOT c", "a NOT b NOT c", "a OR b AND c", "a b OR c", "(a) b", "a (b)", "a AND (b OR c)", '"a b" *',
    "a* + b", "ab*", 'title : "b a"', "nosuch : a", "a AND", "NOT a", "", "a OR", "{title : a", "NEAR(a b", "near(a b)", "a : b", "text : title : a", '"" a', '"" AND a', "a,b", "a-b",
    "text : ^b", "{title text} : NEAR(a b, 1)", "title : {text} : a", "(title : a) AND (text : b)", "title : (text : a OR b)", "AND", "a NEAR b", "NEAR", "NEAR(a, b)", "(a", "a)", "()",
    '"a b" OR "b c" NOT d', "a + b + c", "a + ", "* a", "é", "E",
]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "ab", "abc", "É", "x"]
    rows = [tuple([k] + [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 6, 12)))) for _ in COLUMNS]) for k in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(id unindexed, {', '.join(COLUMNS)})")
    con.executemany(f"insert into t values ({', '.join('?' * (1 + len(COLUMNS)))})", rows)
    own = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in COLUMNS))
    return con, search.with_terms(own).cache()


def expression(rng, deep=2):
    kind = rng.randrange(9) if deep else rng.randrange(5)
    word = lambda: rng.choice(["a", "b", "c", "d", "ab", "a*", "x", '"a b"', '"b c d"'])
    if kind < 2:
        return word()
    if kind == 2:
        return f"NEAR({word()} {word()}{rng.choice(['', ' c'])}, {rng.randrange(4)})"
    if kind == 3:
        return rng.choice(["^", "title : ", "- text : ", "{title locator} : ", "-{headings entities} : "]) + word()
    if kind == 4:
        return f"{word()} {word()}"
    if kind == 8:
        return rng.choice(["title", "- title", "{text headings}"]) + f" : ({expression(rng, deep - 1)})"
    return f"({expression(rng, deep - 1)}) {('AND', 'OR', 'NOT')[kind - 5]} ({expression(rng, deep - 1)})"


def test_same_as_sqlite(tables):
    con, rows = tables
    rng = random.Random(9)
    queries = FIXED + [expression(rng) for _ in range(90)]
    expected, own = {}, {}
    for k, q in enumerate(queries):
        try:
            expected[k] = {r[0] for r in con.execute("select id from t where t match ?", (q,))}
        except sqlite3.OperationalError:
            expected[k] = "syntax"
        try:
            own[k] = search.predicate(search.parse(q))
        except search.QuerySyntaxError:
            assert expected[k] == "syntax" or q == "", q
    for at in range(0, len(queries), 60):
        part = {k: c for k, c in own.items() if at <= k < at + 60}
        hit = rows.select("id", *[c.alias(f"q{k}") for k, c in part.items()]).collect()
        for k in part:
            assert {r["id"] for r in hit if r[f"q{k}"]} == expected[k], queries[k]
    assert sum(isinstance(x, set) and len(x) > 0 for x in expected.values()) > 60


def test_scores_are_sqlites(tables):
    con, rows = tables
    for q in ("a", "a b", '"a b" OR c', "a NOT b", "title : a OR x"):
        expected = {r[0]: r[1] for r in con.execute("select id, bm25(t) from t where t match ?", (q,))}
        node = search.parse(q)
        own = {r["id"]: r["bm25"] for r in search.bm25(rows, node, search.predicate(node)).select("id", F.col("bm25")).collect()}
        assert own.keys() == expected.keys() and all(abs(own[k] - expected[k]) < 1e-6 for k in own), q
