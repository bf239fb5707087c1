"""Clustering, online packing and phrase mining against plain versions, on awkward small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from paperloom.llm import clustering, collocations, online_packing, packing
from paperloom.llm.tokens import encoder, vocabulary

# --- clustering -----------------------------------------------------------------------------------------------------------


def _plain_clusters(rows, k, rounds, dims):
    good = [(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(good, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in named[:k]]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: min((squared(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in good:
            groups[assign(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n])) if groups[n] else c for n, c in enumerate(centroids)]
    found = [(i, *assign(v)) for i, v in good]
    spent = collections.Counter()
    for _, d, n in found:
        spent[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, spent[n], sum(spent.values()), sha[n]) for i, d, n in found), key=str)


def test_cluster(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(6)]) for i in range(150)]
    rows += [(i, [float(rng.randint(-1, 1)) / 64 for _ in range(6)]) for i in range(150, 400)]  # many ties
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, [0.0] * 6), (500, [0.0] * 5), (501, None), (502, []), (503, [None] * 6)]
    rows += [(504, [float("nan")] * 6), (505, [1.0, 2.0, 3.0, float("inf"), 5.0, 6.0]), (506, [100_000.0] * 6), (507, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    own = [(i, [np.float32(x) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    for k, rounds in ((16, 3), (1, 1), (1000, 2), (3, 0)):
        found = clustering.cluster(df, k, rounds, dims=6)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == _plain_clusters(own, k, rounds, 6)
    assert clustering.cluster(df.filter("false"), dims=6).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<double>"), dims=6).collect()


def test_annulus_holds_all_nearest_and_compares_few():
    rng = np.random.default_rng(3)
    centroids = np.concatenate([rng.integers(-4, 5, (60, 8)) * s for s in (1, 10, 100)])
    centroids = np.concatenate([centroids, centroids[:20], -centroids[:20]])  # equal norms, equal vectors
    x = np.concatenate([centroids + rng.integers(-1, 2, centroids.shape), centroids, rng.integers(-500, 500, (200, 8))])
    own = clustering.Centroids(centroids)
    number, squared = own.nearest(x)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (every.min(1) == squared).all() and (every.argmin(1) == number).all()
    assert own.compared < 0.6 * every.size


# --- online packing -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("capacity", "most"), [(1, 1), (16, 1), (16, 4), (100, 32)])
def test_windows(capacity, most):
    rng = random.Random(capacity + most)
    for _ in range(20):
        own, done, sizes = online_packing.Windows(capacity, most), [], [max(1, int(rng.expovariate(2 / capacity))) for _ in range(rng.randint(0, 300))]
        for k, n in enumerate(sizes):
            done += own.place(k, n)
            assert len(own.pieces) == len(own.gaps) <= most
        assert all(sum(p[2] for p in w) == capacity for w in done) and len(own.left()) <= most
        places = sorted(p for w in [*done, *own.left()] for p in w)
        for k, n in enumerate(sizes):
            at = 0
            for _, start, length in (p for p in places if p[0] == k):
                assert start == at and length > 0
                at += length
            assert at == n


@pytest.mark.parametrize(("capacity", "partitions"), [(64, 1), (64, 7), (100, 3)])
def test_pack_online(spark, capacity, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.limit(60).collect()] + [None, "", " \n", "a", "a b c " * 900, "é" * 300, "<|endoftext|>"]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string, ids string, offset int").repartition(partitions)
    found = online_packing.pack_online(df, capacity, most_open=4).collect()
    ids = {k: np.frombuffer(encoder(vocabulary("word_bpe_49k.json")).ids(t) + (2).to_bytes(4, "little"), "<u4") for k, t in enumerate(texts)}
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in found:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == own.tobytes() and r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered.update((r["doc_id"], r["start"] + k) for k in range(r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {(k, j): 1 + (k < 5) for k, x in ids.items() for j in range(len(x))}
    sizes = []
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        sizes.append(at)
    short = [n for n in sizes if n != capacity]
    assert all(n & (n - 1) == 0 for n in short) and sum(short) < capacity and len(set(short)) == len(short)
    whole = packing.sequences(spark.createDataFrame(found)).collect()
    assert sorted(r["n_tokens"] for r in whole) == sorted(sizes)
    assert online_packing.pack_online(df.filter("false")).collect() == []


# --- phrases --------------------------------------------------------------------------------------------------------------


def _plain_phrases(rows, longest, least, share, top):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, *words[i : i + n]) for i in range(len(words) - n + 1))
    own = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for p, a in own.items():
        lang, words = p[0], p[1:]
        inside = lambda q: q[0] == lang and len(q) > len(p) and any(q[1 + i : 1 + i + len(words)] == words for i in range(len(q) - len(words)))
        if any(100 * b >= share * a for q, b in own.items() if inside(q)):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]]))
    return sorted((lang, n + 1, p.decode(), -a, x, y, totals[lang], -s) for lang, found in out.items() for n, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


SMALL = collocations.Limits(slice=40, words=50, paths=30, numbers=20, known=10)


@pytest.mark.parametrize("limits", [collocations.LIMITS, SMALL])
def test_phrases(spark, limits):
    rng = random.Random(11)
    words = ["the", "The", "of", "a", "x\x00y", "é", "É", "und", "Haus", "\x1c", "zz　z", *(f"w{k}" for k in range(40))]
    rows = []
    for k in range(120):
        text = "".join(rng.choices(words, [9, 3, 6, 4, *[1] * 47])[0] + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "?!", " ; "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    rows += [("en", None), ("en", ""), (None, "   "), ("en", "New York City. " * 40), ("fr", "la la " * 60), ("en", "new york, city" * 3)] + [rows[0]] * 4
    df = spark.createDataFrame([(lang, t, "clash", 1, 2) for lang, t in rows], "lang string, text string, phrase string, n int, h1 int").repartition(3)
    for longest, least, share, top in ((3, 10, 50, 2000), (3, 2, 80, 7), (2, 3, 50, 20)):
        found = collocations.mine(df, longest, least, share, top, limits)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in found.collect()) == _plain_phrases(rows, longest, least, share, top)
    assert collocations.mine(df.filter("false")).collect() == [] and collocations.mine(df.filter("text is null")).collect() == []


def test_serialised_tries_read_back():
    rng = np.random.default_rng(1)
    for depth in (2, 3):
        columns = [rng.integers(0, 9, 500).astype(np.uint64) << np.uint64(40 + k) for k in range(depth)]
        counts = np.arange(1, 501)
        batch = collocations._serialised(columns, counts, 16)
        found = collections.Counter()
        for data in batch.column(1).to_pylist():
            own, n = collocations._read(data, depth)
            paths = list(zip(*(c.tolist() for c in own)))
            assert paths == sorted(paths)
            for p, c in zip(paths, n.tolist()):
                found[p] += c
        expected = collections.Counter()
        for p, c in zip(zip(*(c.tolist() for c in columns)), counts.tolist()):
            expected[p] += c
        assert found == expected


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, x, y = 2_000_000_000_000, 2_100_000_000_001, 9_000_000_000_007
    df = spark.createDataFrame([(a, x, y)], "a long, x long, y long")
    assert df.select(collocations._score(F.col("a"), F.col("x"), F.col("y"))).first()[0] == 1_000_000 * a * a // (x * y)
