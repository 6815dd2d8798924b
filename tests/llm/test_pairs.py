"""op4, op5, op6 and op7 against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from quillgraph.llm import hamming, jaccard, pivots, suffix_dedup
from quillgraph.llm.suffix_dedup import Repeats

from tests.llm import brute


def texts(seed: int, n: int) -> list:
    """Documents with exact and near copies, shared passages, periods, accents, nulls, empty, blank and long texts."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé ñ\t") for _ in range(rnd.randint(1, 7))).strip() or "x" for _ in range(400)]
    make = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passage, out = make(60), []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.3 and out:
            words = (rnd.choice(out) or "").split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            out.append(" ".join(words))
        elif kind < 0.45:
            out.append(make(rnd.randint(0, 40)) + passage + make(rnd.randint(0, 40)))
        else:
            out.append(make(rnd.choice([1, 2, 3, 4, 5, 20, 80, 300])))
    return [*out, None, "", "  \n\t ", "word", "Word", "ab" * 300, "ab" * 200 + "c", "a" * 500, make(6000)]


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), i, "x", [1]) for i, t in enumerate(rows)], brute.DOCS + ", doc long, sig string, spans array<int>")


@pytest.mark.parametrize(("width", "percent", "chunk"), [(4, 85, 1000), (5, 80, 3)])
def test_jaccard_is_brute_force(spark, width, percent, chunk):
    rows = texts(1, 140)
    got = jaccard.near_duplicates(spark, docs_frame(spark, rows), jaccard.Similar(width, percent, chunk, 1 if chunk == 3 else 4)).collect()
    want = brute.near_duplicates(dict(enumerate(rows)), width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows)


def test_jaccard_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op6_jaccard(spark, brute.DATA).collect()}
    assert got == brute.near_duplicates(docs, 4, 85)


def test_jaccard_keeps_the_first_of_each_group_and_rows_without_ids(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words in this one"), (None, "a b c d e f"), (3, "other words in this one"), (4, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], brute.DOCS)
    got = jaccard.keep_first(spark, df, jaccard.Similar(5, 80))
    assert sorted((str(r.doc_id) for r in got.collect())) == ["1", "3", "4", "None"]
    assert got.columns == df.columns
    assert jaccard.near_duplicates(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [2000, 2])
def test_repeats_are_brute_force(spark, shard):
    rows = texts(2, 60)
    p = Repeats(length=40, k=24, batches=3, shard=shard)
    docs = docs_frame(spark, rows)
    want = brute.repeats(dict(enumerate(rows)), 40)
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(spark, docs, p).collect()}
    digest = suffix_dedup.digests(spark, docs, p).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {r[0]: tuple(r[1:]) for r in digest.collect()} == want
    assert kept[rows.index(None)] is None
    assert all(len(kept[i].encode()) <= n - gone for i, (n, gone, *_) in want.items() if rows[i] is not None)


def test_rows_of_one_id_and_without_one_are_compared(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, alone, twice = word(120), word(300), word(90)
    rows = [(1, word(30) + passage), (2, passage + word(30)), (2, alone), (None, word(10) + passage), (None, alone[:50] + word(60)), (3, twice), (3, twice), (None, twice), (4, None), (4, "")]
    want = brute.repeats(dict(enumerate(t for _, t in rows)), 40)
    df = spark.createDataFrame([(i, t, "en", "s", None, 1, "x", [1]) for i, t in rows], docs_frame(spark, []).schema)
    got = suffix_dedup.digests(spark, df, Repeats(length=40, k=24)).collect()
    assert sorted(((r[0], *r[1:5]) for r in got), key=repr) == sorted(((i, *want[k]) for k, (i, _) in enumerate(rows)), key=repr)
    assert want[2][1] == 50 and want[5][1] == 90
    kept = suffix_dedup.without_repeats(spark, df, Repeats(length=40, k=24))
    assert kept.count() == len(rows) and kept.columns == df.columns


def test_one_passage_in_many_surroundings_is_counted(spark):
    """More texts than a task compares share one passage; counts find it, with the lists of a group's tasks never used."""
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(40))
    rows = {i: "".join(rnd.choice("abcdefgh") for _ in range(20)) + passage + "".join(rnd.choice("abcdefgh") for _ in range(20)) for i in range(3000)}
    df = docs_frame(spark, list(rows.values()))
    got = suffix_dedup.digests(spark, df, Repeats(length=40, k=24, shard=50)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    want = brute.repeats(rows, 40)
    assert {r[0]: tuple(r[1:]) for r in got} == {i: w[:3] for i, w in want.items()}
    plan = suffix_dedup._counted(spark.createDataFrame([], suffix_dedup.WINDOWS), 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1 and "Python" not in plan


def test_repeats_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.DATA}/documents.parquet").collect()}
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.op5_suffix_dedup(spark, brute.DATA).collect()}
    assert got == brute.repeats(docs, 400)


def test_suffix_index_levels_grow_geometrically(spark):
    index = suffix_dedup.SuffixIndex(spark, Repeats(length=40, k=24))
    for b in range(5):
        index.add(docs_frame(spark, texts(b, 5)))
    ranks = [rank for rank, _ in index.levels]
    assert sorted(ranks) == [0, 2]  # four batches in one level, and the fifth
    suffixes = sum(spark.table(t).agg({"n": "sum"}).first()[0] for _, t in index.levels)
    assert suffixes == sum(suffix_dedup.map_arrow(docs_frame(spark, texts(b, 5)).select("doc_id", "text"), suffix_dedup._runs(index.p), suffix_dedup.RUN).count() for b in range(5))
    index.close()
    assert suffix_dedup.without_repeats(spark, docs_frame(spark, ["a"]).limit(0)).count() == 0


def vectors(seed: int, n: int, dim: int = 6) -> list:
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i and rnd.random() < 0.5:
            v = [x + rnd.gauss(0, rnd.choice([0, 0.02, 0.1])) for x in rnd.choice(out)[1]]
        else:
            v = [rnd.gauss(0, 1) for _ in range(dim)]
        out.append((i, [x * rnd.choice([1, 1, 2.5]) for x in v] if rnd.random() < 0.1 else v, rnd.choice([0, 0, 1, None])))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [1.0, 2.0], [-0.0, 1.0] + [0.0] * (dim - 2), [0.0, 1.0] + [0.0] * (dim - 2), [1e150] * dim]
    return out + [(n + k, v, 0) for k, v in enumerate(odd)]


@pytest.mark.parametrize(("cell", "groups"), [(2000, 9), (25, 9), (25, 1)])
def test_range_join_is_brute_force(spark, cell, groups):
    rows = vectors(3, 250)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, label int, id int, m string")
    got = pivots.range_join(spark, df, pivots.Near(cell=cell, groups=groups, row_cost=0.0)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute.cosine_links(rows, 0.98)
    assert len(got) == len(rows)


def test_pivots_follow_the_data():
    """Clusters get many cells, vectors that all lie far apart few; a pivot's cell holds all that may link into it."""
    rng, p = np.random.default_rng(4), pivots.Near()
    radius = float(np.sqrt(2 - 2 * p.cosine))
    clusters = pivots.unit(np.repeat(rng.standard_normal((40, 64)), 25, axis=0) + 0.01 * rng.standard_normal((1000, 64)))[rng.permutation(1000)]
    alike = pivots.unit(rng.standard_normal((1000, 64)))
    assert len(pivots.chosen(clusters, 1_000_000, p, radius)) >= 16
    assert len(pivots.chosen(alike, 20_000, p, radius)) <= 2
    home, goes = pivots.spread(clusters, clusters[:16], radius)
    near = pivots.linked(p.cosine, clusters, clusters)
    assert all(goes[j, home[i]] for i, j in zip(*np.nonzero(near), strict=True))


def test_links_at_extreme_magnitudes(spark):
    v = [3.0, -1.0, 2.0, 0.5]
    rows = [(k, [x * m for x in v], 0) for k, m in enumerate((1.0, 1e170, 1e-170, 1e300, 1e-300))] + [(9, [-x for x in v], 0), (10, [1e170, 1e-170, 0.0, 0.0], 0), (11, [1e-150, 0.0, 0.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.range_join(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (4, 0) for k in range(5)} | {9: (0, 9), 10: (1, 10), 11: (1, 10)}


def test_range_join_on_the_table_and_on_nothing(spark):
    df = spark.read.parquet(f"{brute.DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.op4_pivots(spark, brute.DATA).collect()}
    assert got == brute.cosine_links(rows, 0.98)
    assert pivots.range_join(spark, df.limit(0)).count() == 0


def recall(got: dict, want: dict) -> float:
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    return hits / max(1, sum(len(x) for x in want.values()))


@pytest.mark.parametrize(("least", "folder"), [(4096, "sf0.1"), (100, "sf0.001")])
def test_hamming_recall(spark, least, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    n, many = df.count(), {}
    want = brute.nearest([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    got: dict = {}
    for r in hamming.nearest(spark, df, hamming.Search(least=least)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        many[r.query_id] = r.n_candidates
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    assert all(len(got[q]) == len(want[q]) and q not in dict(got[q]) for q in want)
    assert recall(got, want) >= 0.9
    exact = {q: dict(x) for q, x in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-9 for q, x in got.items() for i, s in x if i in exact[q])
    if folder == "sf0.1":
        assert sum(many.values()) / len(many) < 0.2 * n  # the rest are left out by their codes


def test_hamming_probes_what_a_scan_finds():
    """In clusters the pigeonhole leaves out most codes, and the result is that of comparing all."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((100, 32))
    x = np.repeat(centres, 40, axis=0) + 0.01 * rng.standard_normal((4000, 32))
    ids = np.arange(len(x))
    codes = hamming.Codes(x, float(np.linalg.norm(x, axis=1).max()), hamming.Search())
    shard = hamming.Shard(ids, x, codes.encode(x, False))
    for q in range(0, 4000, 97):
        code = codes.encode(x[q : q + 1], True)[0]
        rows = shard.within(q, code, codes.margin, 20)
        far = hamming.distances(code[None, :], shard.codes)[0]
        far[q] = hamming.BITS + 1
        edge = np.sort(far)[19] + codes.margin
        assert sorted(rows) == np.flatnonzero(far <= edge).tolist()
        near = shard.probed(code, 1)
        assert len(near) < 1500
        assert set(np.flatnonzero(far < 32)) <= set(near)  # all codes within the radius are probed


def test_hamming_with_odd_rows(spark):
    rows = [(i, v) for i, v, _ in vectors(5, 30) if v is None or len(v) != 2]
    rows += [(60, [1.0] * 6), (61, [1.0] * 6), (62, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")
    got: dict = {}
    for r in hamming.nearest(spark, df, hamming.Search(every=1, k=3)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute.nearest(rows, 3, 1)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    assert got[61][:1] == want[61][:1] or got[61][0][1] == want[61][0][1]
    assert hamming.nearest(spark, df.limit(0)).count() == 0
    # lengths without codes are compared as they are
    few = spark.createDataFrame([(i, [float(i + j) for j in range(1 + i % 5)]) for i in range(40)], "vec_id long, embedding array<double>")
    got = {}
    for r in hamming.nearest(spark, few, hamming.Search(every=1, k=2, lengths=1)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all([i for i, _ in got[q]] == [i for i in sorted(range(q % 5, 40, 5), reverse=True) if i != q][:2] for q in range(1, 40) if q % 5)
