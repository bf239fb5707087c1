"""Several libraries at once against each of them alone, and graphs against plain admission."""

import random

from pyspark.sql import functions as F

from paperloom.operators import concepts, kb, search


def _rows(spark):
    rng = random.Random(12)
    words = ["pump", "seal", "valve", "motor", "alarm", "fault", "x", "2M2001XX-7", "a-b"]
    rows = []
    for library in ("one", "two", "three", "four"):
        own = words[: {"one": 9, "two": 5, "three": 2, "four": 1}[library]]
        rows += [(library, k // 6, f"{library}-{k}", k, " ".join(rng.choices(own, k=rng.randint(1, 9))), rng.choice(["manual_pdf", "fault_catalog_pdf"]), rng.choice(["page", "text"]), rng.choice([None, "p. 1"]), rng.random() < 0.1) for k in range(30)]
    df = spark.createDataFrame(rows, "library_id string, doc_id long, chunk_id string, chunk_ord int, text string, document_kind string, evidence_type string, locator string, is_noisy boolean")
    none = F.lit(None)
    return df.withColumns({
        "title": F.col("chunk_id"), "headings": F.lit(""), "entities": F.lit(""), "noise_score": F.lit(0.0), "noise_reasons": F.array().cast("array<string>"), "document_title": F.lit("D"), "source_file": F.lit("s.pdf"), "source_path": F.lit("/s"), "output_dir": F.lit("o"),
        "heading_path": F.array().cast("array<string>"), "page_number": none.cast("int"), "slide_number": none.cast("int"), "sheet_name": none.cast("string"), "section_number": none.cast("string"),
    }).cache()


def test_each_library_shows_what_it_would_alone(spark):
    rows = _rows(spark)
    for query, aliases in (("motor alarm", {"motor alarm": ["valve seal"]}), ("2M2001XX", None), ("pump, x", None)):
        found = kb.evidence(rows, query, 5, ["three", "one", "absent", "four", "two"], aliases=aliases).orderBy("library_order", "rank").collect()
        assert [r["library_id"] for r in found] == sorted((r["library_id"] for r in found), key=["three", "one", "absent", "four", "two"].index)
        for library in ("one", "two", "four"):
            alone = search.search(rows.filter(F.col("library_id") == library), query, 5, aliases=aliases).orderBy("rank").collect()
            own = [r for r in found if r["library_id"] == library]
            keys = ("rank", "chunk_id", "total_hits", "mode", "query_used", "alias_used", "normalized_used", "matched_tokens")
            assert [tuple(r[k] for k in keys) for r in own] == [tuple(r[k] for k in keys) for r in alone], (query, library)
            assert all(abs(a["score"] - b["score"]) < 1e-9 for a, b in zip(own, alone))
    stages = {r["library_id"]: r["stage"] for r in kb.evidence(rows, "motor alarm", 1, aliases={"motor alarm": ["valve seal"]}).collect()}
    assert len(set(stages.values())) >= 2 and "four" not in stages


def test_context_has_supporting_chunks_of_the_same_document(spark):
    rows = _rows(spark)
    shown, near = kb.context(rows, "pump", 2, 2, ["two", "one"])
    evidence = {(r["library_id"], r["chunk_id"]): r["doc_id"] for r in shown.collect()}
    supporting = near.collect()
    assert len(evidence) == 4 and len(supporting) == 8
    for r in supporting:
        assert evidence[r["library_id"], r["for_chunk_id"]] == r["doc_id"] and r["chunk_id"] != r["for_chunk_id"]
    filtered = kb.evidence(rows, "pump", 50, filters=search.Filters(kinds=["manual_pdf"])).select("chunk_id").collect()
    kinds = {r["chunk_id"]: r["document_kind"] for r in rows.collect()}
    assert filtered and all(kinds[r["chunk_id"]] == "manual_pdf" for r in filtered)


def test_document_entity_graph_is_the_greedy_one(spark):
    rng = random.Random(4)
    documents = [(k, f"doc {'pump' if k % 9 == 0 else 'x'} {k}", k) for k in range(60)]
    entities = [(f"e{k}", f"{'Pump' if k % 7 == 0 else 'y'} {k}", k) for k in range(50)]
    mentions = [(rng.randrange(60), f"e{rng.randrange(50)}", n) for n in range(300)]
    frames = (
        spark.createDataFrame(documents, "doc_id long, title string, doc_ord long"), spark.createDataFrame(entities, "entity_id string, entity_text string, first_ord long"),
        spark.createDataFrame(mentions, "doc_id long, entity_id string, ord long").repartition(4),
    )
    title, name = {str(d): t for d, t, _ in documents}, {e: t for e, t, _ in entities}
    for most, keyword in ((1, None), (2, "pump"), (17, None), (40, "pump"), (500, None)):
        nodes, kept = [], []
        for d, e, _ in sorted(mentions, key=lambda m: m[2]):
            if keyword and keyword not in title[str(d)].lower() and keyword not in name[e].lower():
                continue
            new = [x for x in (str(d), e) if x not in nodes]
            if len(nodes) + len(new) > most:
                continue
            nodes += new
            kept.append((str(d), e))
            if len(kept) >= concepts.edge_limit(most) or len(nodes) >= most:
                break
        if keyword:
            for i, t in [*title.items(), *name.items()]:
                if len(nodes) < most and i not in nodes and keyword in t.lower():
                    nodes.append(i)
        found, edges = concepts.document_entity_graph(*frames, most, keyword)
        assert sorted((r["source"], r["target"]) for r in edges.collect()) == sorted(kept), (most, keyword)
        assert {r["id"] for r in found.collect()} == set(nodes)
