"""A library's written index against SQLite's full-text search, and what its plans read."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from paperloom.operators import index, library, ranks, search
from tests.test_fts import COLUMNS, FIXED, expression


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "ab", "abc", "É", "x", "abcd", "abce"]
    rows = [tuple([str(k)] + [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 6, 12)))) for _ in COLUMNS]) for k in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(id unindexed, {', '.join(COLUMNS)})")
    con.executemany(f"insert into t values ({', '.join('?' * (1 + len(COLUMNS)))})", rows)
    own = spark.createDataFrame(rows, "chunk_id string, " + ", ".join(f"{c} string" for c in COLUMNS)).withColumns({
        "chunk_ord": F.col("chunk_id").cast("int"), "document_kind": F.when(F.col("chunk_id") < "5", "manual_pdf").otherwise("fault_catalog_pdf"), "evidence_type": F.lit("page"), "is_noisy": F.col("chunk_id") == "7",
        "noise_score": F.lit(0.5), "noise_reasons": F.array().cast("array<string>"), "document_title": F.col("title"), "source_file": F.lit("s"), "source_path": F.lit("p"), "output_dir": F.lit("o"),
    })
    return con, own, index.write_index(own, f"file://{tmp_path_factory.mktemp('library')}/build", 16)


def test_same_as_sqlite(tables):
    con, _, own = tables
    rng = random.Random(19)
    queries = FIXED + [expression(rng) for _ in range(70)] + ["abc*", "title : abc* + x", "abcd* OR NEAR(abc* b, 3)"]
    expected, nodes = {}, {}
    for k, q in enumerate(queries):
        try:
            nodes[k] = search.parse(q)
        except search.QuerySyntaxError:
            continue
        expected[k] = {r[0] for r in con.execute("select id from t where t match ?", (q,))} if q else set()
    for at in range(0, len(queries), 45):
        part = {k: n for k, n in nodes.items() if at <= k < at + 45}
        found, places = own.with_places(list(part.values()))
        hit = found.select("chunk_id", *[search.predicate(n, places).alias(f"q{k}") for k, n in part.items()]).collect()
        for k in part:
            assert {r["chunk_id"] for r in hit if r[f"q{k}"]} == expected[k], queries[k]


def test_search_of_an_index_is_that_of_its_rows(tables):
    con, rows, own = tables
    for q in ("a b", '"a b" OR c', "title : a OR x", "nosuchword a fault", "a, b", "(a", "nosuch"):
        for filters in (None, search.Filters(kinds=["manual_pdf"])):
            expected, found = ([r.asDict() for r in search.search(x, q, 7, 1, filters).orderBy("rank").collect()] for x in (rows, own))
            for r in (*expected, *found):
                r["score"] = round(r["score"], 9)
            assert found == expected, q
    scores = {r[0]: r[1] for r in con.execute("select id, bm25(t) from t where t match 'a OR \"b c\"'")}
    got = {r["chunk_id"]: r["score"] - r["adjustment"] for r in own.any_of(['a OR "b c"'], search.Filters(), None)[0].collect()}
    assert got.keys() == scores.keys() and all(abs(got[k] - scores[k]) < 1e-6 for k in got)


def test_queries_read_the_buckets_of_their_terms(tables):
    _, _, own = tables
    plan = own.matching(search.parse('"abc x" OR abcd*'))._jdf.queryExecution().toString()
    assert "terms_" not in plan and "regexp" not in plan
    buckets = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|INSET)\s*\(?([\d,]+)", plan)
    assert buckets and len(buckets[1].split(",")) <= 2
    assert "StartsWith" in plan.partition("PushedFilters")[2] or "StringStartsWith" in plan
    page = own.fetch(["3"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", page)


def test_containment_has_no_nested_loop(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Pump", "pump", "s7-300", "Öl", "STRASSE", "straße", "a", "ab", "x1"]
    chunks = [(str(k), k, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randint(0, 30))), None if k % 3 else "p. 1", ["h1", "ab x1"] if k % 5 == 0 else None) for k in range(80)]
    entities = [(f"e{k}", " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice([None, *range(60)])) for k in range(60)] + [("same", "pump", 3), ("tiny", "a", 0), ("none", None, 0)]
    own = spark.createDataFrame(chunks, "chunk_id string, doc_ord int, title string, text string, locator string, heading_path array<string>")
    names = spark.createDataFrame(entities, "entity_id string, entity_text string, first_doc_ord int")
    fold = lambda t: t.lower().replace("ß", "ss")
    for most in (1_000_000, 40):
        monkeypatch.setattr(library, "MOST_LETTERS", most)
        for bounded in (False, True):
            found = library.contained(own, names, bounded)
            assert "NestedLoop" not in found._jdf.queryExecution().toString()
            expected = {(c[0], e[0]) for c in chunks for e in entities if e[1] and len(fold(e[1])) >= 2 and fold(e[1]) in fold(" ".join(x for x in (*c[2:5], " ".join(c[5]) if c[5] else None) if x is not None)) and (not bounded or e[2] is not None and e[2] <= c[1])}
            rows = [tuple(r) for r in found.collect()]
            assert set(rows) == expected and len(rows) == len(expected)
    assert library.contained(own, names.filter("false")).count() == 0 and library.contained(own.filter("false"), names).count() == 0


def test_nearest_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    rows = [(d, f"{d}-{k}", k * 2, rng.choice([None, 1, 2]), rng.choice([None, None, 1]), rng.choice([None, "s"]), rng.choice([None, 1, 2, 3])) for d in (1, 2, 3) for k in range(12 * d)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_ord int, page_number int, slide_number int, sheet_name string, section_number int")
    same = lambda a, b, k: a[k] is not None and a[k] == b[k]
    for limit in (1, 3, 50):
        expected = set()
        for t in rows:
            others = [(0 if same(t, o, 3) or same(t, o, 4) else 1 if same(t, o, 5) or same(t, o, 6) else 2, abs(t[2] - o[2]), o[2], o[1]) for o in rows if o[0] == t[0] and o[1] != t[1]]
            expected |= {(t[1], o[3], o[0], o[1], n + 1) for n, o in enumerate(sorted(others)[:limit])}
        found = search.nearest(df, df, limit)
        assert {(r["target_id"], r["chunk_id"], r["context_rank"], r["distance"], r["position"]) for r in found.collect()} == expected
    one = search.related(df, df.filter("chunk_id = '2-5'"), 2)
    assert one.count() == 2 and {"page_number", "target_id", "position"} <= set(one.columns)


def test_numbers_of_a_key_that_fills_several_ranges(spark):
    rows = [(k, "hot" if k % 5 else f"k{k % 7}", None if k % 11 == 0 else k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string, other int").repartition(7)
    found = ranks.numbered(df, ["key", "other"], ["id"], "n")
    counts, expected = {}, set()
    for r in rows:
        counts[r[1:]] = counts.get(r[1:], 0) + 1
        expected.add((*r, counts[r[1:]]))
    assert {tuple(r) for r in found.collect()} == expected
    windows = re.findall(r"windowspecdefinition\(([^)]*)", found._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("_range" in w for w in windows)


def test_containment_queries_take_texts_as_their_sql_does(spark, tmp_path):
    """ß is not ss, no space follows the last part, and texts of one letter or none count."""
    import duckdb

    from paperloom.plans.queries import ORACLE_SQL, QUERIES

    texts = ["Die STRASSE hier", "die straße hier", "am Ende", "", None, "x y\nÖl"]
    spark.createDataFrame([(k, t, "de", "s1") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(["Straße", "strasse", "ende ", "x", "", None, "öl"])), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("entity_containment", "entity_containment_bounded"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.sql(ORACLE_SQL[name]).fetchall())


def test_postings_are_made_without_a_shuffle(tables, spark):
    _, rows, own = tables
    terms = search.with_terms(rows).withColumns({"length": F.lit(1.0), "adjustment": F.lit(0.0)})
    made = index.postings_of(terms)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    expected = {}
    for r in terms.collect():
        for c in search.INDEXED:
            for k, t in enumerate(r[f"terms_{c}"]):
                expected.setdefault((t, c, r["chunk_id"]), []).append(k)
    got = [((r["term"], r["column"], r["chunk_id"]), r["positions"]) for r in own.postings.collect()]
    assert dict(got) == expected and len(got) == len(expected)
    mentions = spark.createDataFrame([("1", "x", "x")], "chunk_id string, entity_text string, normalized_text string")
    assert "Join" not in own.any_of(["a"], search.Filters(), mentions)[0]._jdf.queryExecution().optimizedPlan().toString()


def test_postings_of_a_block_are_in_the_order_of_terms(tables):
    """A task's sort is then mostly a merge of such blocks."""
    _, rows, _ = tables
    terms = search.with_terms(rows).withColumns({"length": F.lit(1.0), "adjustment": F.lit(0.0)}).coalesce(1)
    found = {}
    for r in index.postings_of(terms).collect():
        found.setdefault(r["column"], []).append((r["term"].encode(), r["chunk_id"]))
    assert len(found) > 3 and all(x == sorted(x) for x in found.values())


def test_a_built_library_has_one_file_for_a_bucket_of_rows(spark, tmp_path):
    """Rows come out of joins in many parts; each part would have a file in each bucket. Chunks are those of the library."""
    from paperloom.operators import workspace

    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("pump mail a"), F.col("id") % 7, F.lit("@b.de NaN")).alias("text"))
    documents = texts.select("doc_id", F.col("doc_id").alias("doc_ord"), *[F.lit(c).alias(c) for c in ("title", "source_file", "source_path", "document_kind", "output_dir")])
    chunks = texts.select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_ord"), F.lit("t").alias("title"), "text", F.when(F.col("doc_id") % 2 == 0, "p").alias("locator"), F.array().cast("array<string>").alias("heading_path"), F.lit("page").alias("evidence_type"))
    chunks = chunks.union(chunks.limit(1).withColumns({"chunk_id": F.lit("lost"), "doc_id": F.lit(999).cast("long")}))  # of no document
    assets = spark.createDataFrame([], "asset_id string, doc_id long, path string")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        built = library.build(documents, chunks, library.extract_entities(texts, {"email": library.ENTITY_RULES["email"]}), assets)
        folder = workspace.build_library(built, f"file://{tmp_path}")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.parquet(f"{folder}/index")
    files = kept.select("bucket", F.col("_metadata.file_path").alias("f")).distinct().groupBy("bucket").count()
    assert files.filter("count > 1").count() == 0 and kept.count() == 300
    names = built.chunks.columns
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/chunks").select(names).collect()), key=str) == sorted(map(tuple, built.chunks.collect()), key=str)
    one = kept.filter("chunk_id = '8'").first()
    assert one["entities"] == "a1@b.de" and one["document_kind"] == "document_kind" and one["noise_reasons"] == ["nan_density"] and one["terms_entities"] == ["a1", "b", "de"]
    assert built.mentions.filter("chunk_id is not null").count() == 300 and index.open_index(spark, folder).matching(search.parse("pump")).count() == 300


def test_containment_scans_chunks_once(spark, monkeypatch):
    """However many blocks the entities make, and however small the parts of chunks that they go through."""
    rng = random.Random(5)
    words = [f"w{k}x" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(60)]
    own = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "chunk_id string, text string").withColumns({"doc_ord": F.lit(1), "title": F.lit(""), "locator": F.lit(""), "heading_path": F.array().cast("array<string>")})
    names = spark.createDataFrame([(f"e{w}", w, 0) for w in words], "entity_id string, entity_text string, first_doc_ord int")
    monkeypatch.setattr(library, "MOST_LETTERS", 30)
    for most in (1 << 27, 1):
        monkeypatch.setattr(library, "MOST_BYTES", most)
        found = library.contained(own.repartition(3), names)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert sorted(map(tuple, found.collect())) == sorted((str(k), f"e{w}") for k, t in enumerate(texts) for w in words if w in t)
