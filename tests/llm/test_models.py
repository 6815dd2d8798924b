"""op1, op8 and op9: held-out accuracy, exact parts, and odd rows."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from quillgraph.llm import quality, suffix_tree, toxicity
from quillgraph.llm.fitting import logistic

from tests.llm import brute

BIG = "/root/testdata/sf0.01"


def balanced(rows, truth: dict) -> float:
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    return sum(np.mean([p == t for p, t in held if t == y]) for y in (0, 1)) / 2


@pytest.mark.parametrize(("op", "label", "folds", "out"), [(toxicity.op1_toxicity, "toxic", 4, 2), (quality.op9_quality, "quality", 5, 0)])
def test_held_out_accuracy(spark, op, label, folds, out):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = op(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id, folds) == out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert balanced(rows, truth) >= 0.8


def test_models_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "a b", 5), (1, "x " * 30_000, 6)], "doc_id long, text string, y int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        got = quality.score(docs, quality.fit(docs, labels)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].y == 3
        got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def segments_by_definition(s) -> list:
    """The best segment of all, then those to its left and right, again and again."""

    def split(lo, hi):
        best = max(((s[i:j].sum(), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, n = -best[2], -best[1]
        return [*split(lo, i), (i, i + n - 1, best[0]), *split(i + n, hi)]

    return split(0, len(s))


def test_maximal_segments():
    rng = np.random.default_rng(0)
    for k in range(120):
        s = rng.normal(0, 1, 14) if k % 2 else rng.choice([-2.0, -0.5, 1.0, 2.0], 12)
        got, want = toxicity.maximal_segments([(i, x) for i, x in enumerate(s)], -1.0), segments_by_definition(s)
        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in want))
        assert max((x[2] for x in got), default=0) == pytest.approx(max((x[2] for x in want), default=0))
        if k % 2:  # no ties: the places too
            assert [x[:2] for x in got] == [x[:2] for x in want]
    # positions without a hit drift
    s = np.full(30, -0.3)
    hits = [(i, float(x)) for i, x in zip(sorted(rng.choice(30, 9, replace=False).tolist()), rng.normal(1, 1, 9), strict=True)]
    for i, x in hits:
        s[i] = x
    assert [x[:2] for x in toxicity.maximal_segments(hits, -0.3)] == [x[:2] for x in segments_by_definition(s)]


def test_the_scan_is_linear():
    """Lines that are run, not seconds: on alternating hits a scan that walks back over all segments takes their square."""

    def lines(n: int) -> int:
        count = 0

        def trace(frame, event, _):
            nonlocal count
            count += event == "line"
            return trace

        hits = [(i, 1.0 if i % 2 == 0 else -2.0) for i in range(n)]
        sys.settrace(trace)
        try:
            toxicity.maximal_segments(hits, -0.02)
        finally:
            sys.settrace(None)
        return count

    assert lines(40_000) < 2.2 * lines(20_000)
    assert lines(40_000) < 40 * 40_000


def test_suffix_tree_counts_and_probabilities(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.DATA}/documents.parquet").collect()}
    want = brute.base_scores(rows)
    got = {r.doc_id: r for r in suffix_tree.op8_suffix_tree(spark, brute.DATA).collect()}
    assert got.keys() == want.keys()
    for i, (held, n, known, train, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_suffix_tree_sums_to_one(spark):
    """After each context, the shares of all known tokens, the end and one unknown token, read from scores, sum to one."""
    rows = [(i, " ".join("abcab"[(i + k) % 5] for k in range(9)), 0) for i in range(200) if brute.fold(i, 5) != 1]
    held = [i for i in range(1000, 1400) if brute.fold(i, 5) == 1]
    contexts, known = ["a", "a b", "b c", "zz a", "c a b"], ["a", "b", "c", "unseen"]
    asked, ids = [], iter(held)
    for ctx in contexts:
        asked += [(next(ids), ctx, (ctx, None))] + [(next(ids), f"{ctx} {w}", (ctx, w)) for w in known]
    df = spark.createDataFrame(rows + [(i, t, 0) for i, t, _ in asked], "doc_id long, text string, block long")
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(spark, df, suffix_tree.Tree()).collect()}
    score = {key: got[i] for i, _, key in asked}
    docs = {i: t for i, t, _ in rows} | {i: t for i, t, _ in asked}
    # the end's share after a context and one more token comes from the definition
    want, _ = tree_scores(docs, 2, suffix_tree.Tree().sigma)
    assert all(score[key] == pytest.approx(want[i], rel=1e-7) for i, _, key in asked)
    share = next_shares(docs, contexts, known)
    assert all(sum(share[c].values()) == pytest.approx(1.0) for c in contexts)


def test_suffix_tree_with_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 0, "m"), (2, "", 0, "m"), (None, "a", 1, "m"), (2, "", 0, "m")], "doc_id long, text string, block long, token string")
    got = suffix_tree.score_documents(spark, odd).collect()
    assert len(got) == 4 and all(r.score <= 0 for r in got)
    assert suffix_tree.score_documents(spark, odd.limit(0)).count() == 0


def test_model_distributions_sum_to_one():
    m = suffix_tree.Model(n=100, v=4, seen=(1, 1, 0, 0), frequent={b"a": 0, b"b": 1})
    c = np.array([1.0, 2.0, 40.0, 57.0])
    p = 10 ** m.root(np.append(c, 0.0))
    assert p.sum() == pytest.approx(1.0)
    unigram = p[2:4]
    context, token, n = np.array([0, 0, 0]), np.array([-1, 0, 1]), np.array([5, 1, 34])
    m.levels.append(suffix_tree._retain(m, context, token, n, unigram, 1, suffix_tree.Tree()))
    keys, factor, pairs, value = m.levels[0]
    assert keys.tolist() == [0]
    assert (10**value).sum() + (1 - unigram.sum()) * 10 ** factor[0] == pytest.approx(1.0)


def tree_scores(docs: dict, least: int, sigma: float) -> tuple[dict, int]:
    """doc_id -> score by the definition, with all contexts in dictionaries, and the depth of the longest retained one."""
    toks = {i: [*brute.lower(t), None] for i, t in docs.items()}
    train = [t for i, t in toks.items() if brute.fold(i, 5) != 1]
    c = Counter(w for t in train for w in t)
    m = suffix_tree.Model(sum(c.values()), len(c), tuple(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))
    p = {(): lambda w: float(10 ** m.root(np.array([c[w]]))[0])}
    kept, open_, deepest = {()}, {()}, 0

    def prob(ctx, w):
        return p[ctx](w) if ctx in kept else prob(ctx[1:], w)

    for depth in range(1, 100):
        follow = defaultdict(Counter)
        for t in train:
            for i in range(depth, len(t)):
                if tuple(t[i - depth + 1 : i]) in open_:
                    follow[tuple(t[i - depth : i])][t[i]] += 1
        open_ = set()
        for ctx, n in follow.items():
            total, k = sum(n.values()), len(n)
            g = 2 * sum(x * np.log(x / total / prob(ctx[1:], w)) for w, x in n.items())
            keeps = total >= least and not (k == 1 and g < 20 or g <= k - 1 + sigma * np.sqrt(2 * max(k - 1, 1)))
            if keeps:
                deepest = depth
                p[ctx] = lambda w, n=n, total=total, k=k, ctx=ctx: (total * (n[w] / total) + k * prob(ctx[1:], w)) / (total + k)
            if total >= least and k > 1 and (keeps or depth == 1):
                open_.add(ctx)
        kept |= p.keys()
        if not open_:
            break
    tree_scores.after = lambda t: p[next(x for d in range(min(len(t), deepest), -1, -1) if (x := tuple(t[len(t) - d :])) in kept)]
    longest = lambda t, i: next(x for d in range(min(i, deepest), -1, -1) if (x := tuple(t[i - d : i])) in kept)
    return {i: sum(np.log10(p[longest(t, i)](w)) for i, w in enumerate(t)) for i, t in toks.items()}, deepest


def next_shares(docs: dict, contexts: list, known: list) -> dict:
    """context -> next token -> its probability, by the definition's longest retained suffix."""
    tree_scores(docs, 2, suffix_tree.Tree().sigma)
    return {c: {w: tree_scores.after(brute.lower(c))(w) for w in [*(w.encode() for w in known), None]} for c in contexts}


def test_logistic_and_strengths_by_their_definition():
    """The weights are where the penalised loss is flat, and a document's strength is the sum over its features' steps."""
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((400, 5)), (rng.random(400) < 0.4).astype(float)
    w = logistic(x, y, 0.5, False)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (y - p) - 0.5 * w).max() < 1e-4
    docs = rng.standard_normal((300, 14))
    good = (docs[:, 0] + 0.5 * docs[:, 3] + 0.3 * rng.standard_normal(300) > 0).astype(int)
    m = quality.BradleyTerry(docs, good, quality.Quality(pairs=4000))
    for row in docs[:20]:
        at, naive = 0, 0.0
        for j, edges in enumerate(m.edges):
            for e in edges:
                naive += m.weights[at] * (row[j] > e)
                at += 1
        assert m.strength(row[None, :])[0] == pytest.approx(naive)
    s = m.strength(docs)
    wins = np.mean([s[a] > s[b] for a in np.flatnonzero(good)[:80] for b in np.flatnonzero(good == 0)[:80]])
    assert wins > 0.9  # preferred documents are the stronger ones of their pairs
    assert ((m.score(docs) >= 0.3) == (s >= m.calibrated.cut - 1e-12)).all()


def test_suffix_tree_against_the_definition(spark):
    """Contexts of any depth that occur least times, however many tokens there are, with all their successors."""
    rng = np.random.default_rng(3)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.DATA}/documents.parquet").limit(60).collect()}
    rows |= {10_000 + i: f"{'pq'[i % 2]} one two three four {'xy'[i % 2]} {rng.integers(50)} rare{i % 40}" for i in range(300)}
    rows |= {20_000 + i: " ".join(f"f{rng.integers(20)}" for _ in range(1000)) for i in range(20)} | {30_000: None, 30_001: ""}
    df = spark.createDataFrame([(i, t, i % 7) for i, t in rows.items()], "doc_id long, text string, block long")
    p = suffix_tree.Tree()
    want, deepest = tree_scores(rows, 2, p.sigma)
    assert deepest >= 2
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(spark, df, p).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-7) for i in want), deepest


def test_suffix_tree_in_small_blocks_and_slices(spark):
    """Many blocks, contexts dealt to many buckets, and depths that start from what was written, give the scores of the definition;
    what is scored at last shuffles no text."""
    rng = np.random.default_rng(5)
    rows = {}
    for i in range(300):
        bits = [1, 0, 1, 0, 1]
        for _ in range(rng.integers(0, 100)):  # each word depends on the five before it
            bits.append(int(rng.random() < 1 / (1 + np.exp(-0.8 * (2 * sum(bits[-5:]) - 5)))))
        rows[i] = " ".join("no yes".split()[b] for b in bits) + f" w{rng.integers(30)}"
    df = spark.createDataFrame([(i, t, 0) for i, t in rows.items()], "doc_id long, text string, block long")
    want, deepest = tree_scores(rows, 2, suffix_tree.Tree().sigma)
    assert deepest >= 4
    scored = suffix_tree.score_documents(spark, df, suffix_tree.Tree(tokens=1500, slice=500))
    assert "text" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-7) for i in want)


def test_suffix_tree_blocks_tell_themselves_what_was_written(spark):
    """After the first depths a block's numbers and probabilities lie with it: later depths meet it with nothing but their own answers."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join("no yes".split()[b] for b in (rng.random(80) < 0.5).cumsum() % 2)) for i in range(120)]
    scored = suffix_tree.score_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), suffix_tree.Tree(tokens=1500))
    assert not [f for f in scored.inputFiles() if "/names/" in f]
    assert scored.count() == len(rows)


def test_suffix_tree_words_are_those_of_the_contract():
    texts = [None, "", " ", "\t\x0b\x0c\r\n", "a", " A\x1cb  Ü\u2003É\x85\xa0z\x0bQ ", "\x00 \x1f", "end "]
    table = pa.array(texts, pa.string())
    words, size = suffix_tree._words(table)
    want = [suffix_tree.tokens(t) for t in texts]
    assert size.tolist() == [len(w) for w in want]
    assert words.cast(pa.binary()).to_pylist() == [w for ws in want for w in ws if w != suffix_tree.END]
    some, sizes = suffix_tree._words(table.slice(4, 3))
    assert sizes.tolist() == [len(w) for w in want[4:7]] and some.cast(pa.binary()).to_pylist() == [w for ws in want[4:7] for w in ws if w]
