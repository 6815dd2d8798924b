"""op2, op3 and op10, and the pipeline: round trips and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quillgraph.llm import licences, mixing, packing
from tokenizers import Tokenizer

from tests.llm import brute

ODD = [(1, None), (2, ""), (3, "Hello, world... <|endoftext|> it's <|x|>"), (4, "w " * 9000), (5, "é" * 3000), (6, " a　b\x1c c"), (6, "twice"), (None, "no id"), (8, "don't stop. Stop, now!! a,b 3.14 İstanbul ǅ")]


def pieces_hold(rows, texts: list, full: int = 4096):
    tok = Tokenizer.from_file(packing.tokenizer_file())
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, mine in by_doc.items():
        if len(ids[i]) > 1:
            assert sum(r.length for r in mine) == sum(map(len, ids[i]))
            continue
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i][0])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][0][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[i][0])
    padded = 0
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= full
        padded += 0 if at & (at - 1) == 0 else full - at
    return padded / max(1, sum(r.length for r in rows))


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{brute.DATA}/documents.parquet")
    padded = pieces_hold(packing.op2_packing(spark, brute.DATA).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padded < 0.01
    odd = spark.createDataFrame([(i, t, 0) for i, t in ODD], "doc_id long, text string, offset int").repartition(1)
    assert pieces_hold(packing.pack_documents(odd, packing.tokenizer_file()).collect(), ODD) < 0.5
    assert packing.pack_documents(odd.limit(0), packing.tokenizer_file()).count() == 0


def test_words_have_the_tokenizers_ids():
    """Capitals with every combining mark, scripts without spaces, kelvin signs and the like, alone and mixed."""
    import random
    import string

    tok, mine = Tokenizer.from_file(packing.tokenizer_file()), packing.WordTokenizer(packing.tokenizer_file())
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [f"{a}{m} x{a}{m}y abc" for a in string.ascii_letters for m in marks]
    texts += ["漢字 テスト カ\u3099 한글 ᄒ\u1161", "K Å İstanbul ǅ ſ ß ﬁ", "Y\u030a abc Y\u030a", "a\u0323\u0307 A\u0307\u0323 e\u0301E\u0301", "don\u0301't STOP\u0301. <|Y\u030a|>", "हिन्दी ไทย مرحبا 𝒳𝓎 😀X\u0301"]
    rnd = random.Random(6)
    some = [*string.ascii_letters, *marks[:40], *"éßİǅ漢字カ \u3099한\u00a0　.,'1😀", " ", " ", "\n"]
    texts += ["".join(rnd.choice(some) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert mine.encode(texts) == want
    assert mine.encode(texts[::-1]) == want[::-1]  # now all words are known
    words = ["漢字", "ab", "cd", "x"]  # two pieces in one word: as many ends as words with one that has none would have
    assert b"".join(mine.encode([" ".join(words)])) == np.array(tok.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_keeps_every_limit():
    lim = packing.Limits(tokens=64, segments=3, loss_tokens=20, pool_tokens=500)
    p, rng = packing.Packer(lim, 0), np.random.default_rng(1)
    size = {}
    for doc in range(300):
        n = int(rng.integers(1, 150))
        size[doc] = n
        p.add(doc, np.arange(n, dtype="<u4").tobytes(), loss_from=int(rng.integers(0, n + 1)))
    p.finish()
    by_seq, by_doc = defaultdict(list), defaultdict(int)
    for doc, _, n, _, _, loss, seq, _ in p.done:
        by_seq[seq].append((n, loss))
        by_doc[doc] += n
    assert dict(by_doc) == size
    assert all(len(x) <= 3 and sum(n for n, _ in x) <= 64 and sum(k for _, k in x) <= 20 for x in by_seq.values())


def test_mixing(spark):
    mix = mixing.Mix()
    docs = spark.read.parquet(f"{brute.DATA}/documents.parquet")
    size = {r.doc_id: len(brute.lower(r.text)) for r in docs.collect()}
    rows = mixing.op10_mixing(spark, brute.DATA).collect()
    again = mixing.op10_mixing(spark, brute.DATA).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert {r.doc_id: r["size"] for r in rows} == size
    taken, goal = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        source = r.source_size, r.target
        taken[source] += r.taken
        goal[source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    total = sum(size.values())
    assert sum(goal.values()) == pytest.approx(min(1.5 * total, 2 * total))
    odd = spark.createDataFrame([(1, None, None, 1), (2, "a b", None, 2), (2, "a b", "é", 3), (3, " ", "a", 4), (None, "c d e", "a", 5)], "doc_id long, text string, source string, epoch int")
    assert mixing.mix_documents(spark, odd, mix).count() == 5
    assert mixing.mix_documents(spark, odd.limit(0), mix).count() == 0
    assert set(mixing.mixed_texts(spark, odd, mix).columns) == set(odd.columns)


def test_mixing_takes_the_first_blocks_of_each_permutation(spark):
    """Taken words by the definition: each source's blocks, in the order of their bucket and hash, until the epoch's quota is met."""
    mix = mixing.Mix(block_words=40)
    docs = spark.read.parquet(f"{brute.DATA}/documents.parquet").limit(60)
    size = {r.doc_id: (len(brute.lower(r.text)), r.source) for r in docs.collect()}
    sources = sorted({s for _, s in size.values()}, key=lambda s: (s is None, (s or "").encode()))
    total = [sum(n for n, x in size.values() if x == s) for s in sources]
    goal = mixing.targets(total, mix)
    blocks = [(i, k, n - k if n - k < 40 else 40) for i, (n, _) in size.items() for k in range(0, n, 40)]
    rows = spark.createDataFrame([(e, i, k, w) for e in (1, 2) for i, k, w in blocks], "epoch int, doc_id long, start long, words long")
    h = F.xxhash64(F.lit(mix.seed), "epoch", "doc_id", "start")
    hashed = rows.select("*", h.alias("h"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(mix.buckets)).alias("bucket")).collect()
    want = Counter()
    for s, whole, target in zip(sources, total, goal, strict=True):
        for epoch in (1, 2):
            left = max(0, min(whole, round(target) - (epoch - 1) * whole))
            for r in sorted((r for r in hashed if r.epoch == epoch and size[r.doc_id][1] == s), key=lambda r: (r.bucket, r.h, r.doc_id, r.start)):
                want[r.doc_id] += min(left, r.words)
                left -= min(left, r.words)
    assert {r.doc_id: r.taken for r in mixing.mix_documents(spark, docs, mix).collect()} == {i: want[i] for i in size}


def test_mixed_texts_are_dealt_and_shuffled(spark):
    """Rows sorted by source leave in shards, each in the order of its shuffle, with a document's epochs apart."""
    mix = mixing.Mix(block_words=1 << 40, shards=4, weights=(5.0, 2.0))
    docs = spark.createDataFrame([(i, f"w{i} " * 10, "a" if i < 200 else "b", i) for i in range(400)], "doc_id long, text string, source string, shard int").repartitionByRange(1, "doc_id")
    _, _, drawn = mixing.draw(spark, docs.select("doc_id", "text", "source"), mix)
    want = defaultdict(list)
    for r in sorted(drawn.collect(), key=lambda r: r.position):
        want[r["shard"]].append(r.doc_id)
    assert len(want) == 4 and max(map(len, want.values())) - min(map(len, want.values())) <= 2
    got = defaultdict(list)
    for r in mixing.mixed_texts(spark, docs, mix).select("*", F.spark_partition_id().alias("part")).collect():
        got[r.part].append(r.doc_id)
        assert r["shard"] == r.doc_id
    where = {}
    for part, mine in got.items():
        at = 0
        while at < len(mine):
            k = next(k for k, x in want.items() if k not in where and mine[at : at + len(x)] == x)
            where[k], at = part, at + len(want[k])
    assert where.keys() == want.keys()
    assert sum(map(len, got.values())) > len({i for x in got.values() for i in x})
    for x in got.values():
        assert all(a != b for a, b in zip(x, x[1:], strict=False))
        assert sum((a < 200) != (b < 200) for a, b in zip(x, x[1:], strict=False)) > len(x) / 5


def test_splitting_tree_meets_quotas():
    counts = [1000, 3, 0, 517]
    tree = mixing.SplittingTree(counts, 16, 7)
    got = [np.bincount(tree.shard(s, np.arange(n)), minlength=16) for s, n in enumerate(counts)]
    total = sum(got)
    assert [g.sum() for g in got] == counts and total.max() - total.min() <= 4
    assert mixing.targets([100, 10, 1], mixing.Mix()) == pytest.approx([144.5, 20, 2])


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    rows = [(1, mit), (2, "MIT License\n\nCopyright (c) 2020 A. Person\n" + mit.upper().replace(",", ";")), (3, mit.replace("sublicense", "sub-licence")), (4, mit + " and more"), (5, None), (6, ""), (7, "Copyright 2020")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licence string")
    got = {r.doc_id: r.licence for r in licences.scan(spark, df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None}
    assert licences.scan(spark, df.limit(0)).count() == 0


def test_licences_in_other_wrappings(spark):
    """Every known licence, wrapped anew, on one line, and after lines of holders; body text that begins with the word stays."""
    rows, want = [], {}
    for name, text in licences.KNOWN.items():
        one = " ".join(text.split())
        title, body = ("", one) if "title" not in name else one.partition("icense ")[0::2]
        title = title and title + "icense"
        forms = [text, one, *(textwrap.fill(one, w, break_long_words=False) for w in (30, 41, 55, 60, 72, 80, 120)), *(textwrap.fill(one, w, initial_indent="# ", subsequent_indent="# ", break_long_words=False) for w in (64, 77))]
        forms += [re.sub(rf"\s({w})", r"\n\1", one) for w in ("copyright", "COPYRIGHT")]
        for holder in ("Copyright (c) 2019-2021, A. Person <a@b.example>", "(C) Copyright 2020 Some Firm, Inc. All rights reserved.", "Copyright © 2020 Ä. Ö.", "Copyright 2020 Nobody", "(c) 2020 Nobody"):
            forms += [f"{title}\n{mark}{holder}\n{body}" for mark in ("", "# ", " * ", "// ")] + [f"{title} {holder} {body}".strip(), f"{title}\n{holder}\r\nAll rights reserved.\r\n\r\n{body}"]
        for form in forms:
            want[len(rows)] = licences.named(name)
            rows.append((len(rows), form))
    plain = ["copyright holders may not\nbe named", "may not\ncopyright holders", "Copyright (c) 2020 " + "unknown words " * 30]
    rows += [(-1 - i, t) for i, t in enumerate(plain)]
    got = {r.doc_id: r for r in licences.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licence for i, r in got.items() if i >= 0} == want
    assert licences.canonical(plain[0]) == "copyright holders may not be named"
    assert licences.canonical(plain[2]).startswith("unknown words unknown")
    assert all(got[i].digest == hashlib.sha256(licences.canonical(t).encode()).hexdigest() for i, t in rows)


def test_licences_keep_other_scripts(spark):
    """A licence with other text beside it, in whatever script, isn't the licence."""
    mit = licences.KNOWN["MIT"]
    assert "subject" not in licences.KNOWN["MIT-0"] and "included in all copies" not in licences.KNOWN["MIT-0"]
    other = ["\u672c\u8f6f\u4ef6\u6309\u539f\u6837\u63d0\u4f9b\u3002" * 500, "\u043b\u0438\u0446\u0435\u043d\u0437\u0438\u044f", "\u0932\u093e\u0907\u0938\u0947\u0902\u0938", "\u00e9"]
    rows = [(i, mit + t) for i, t in enumerate(other)] + [(10 + i, t) for i, t in enumerate(other)] + [(20, mit + " \u2014\u3002\u201c\u201d")]
    got = {r.doc_id: r for r in licences.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licence for i, r in got.items()} == {i: "MIT" if i == 20 else None for i, _ in rows}
    assert len({r.digest for r in got.values()}) == len(rows)


def test_licences_by_sql(spark):
    """Texts that are licences, through the registered SQL."""
    rows = [(i, f"Copyright (c) 2020 A. Person\n{t}" if i % 2 else t.upper()) for i, t in enumerate(licences.KNOWN.values())] + [(900, "plain"), (901, None), (902, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {i: n for i, _, n in con.sql(licences.ORACLE).fetchall()}  # the SQL's digests leave out more lines
    got = {r.doc_id: r.licence for r in licences.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sum(n is not None for n in got.values()) == len(licences.KNOWN)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{brute.DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, brute.DATA).cache()
        if name == "near_duplicates":
            rows = {r.doc_id: r.text for r in before.collect()}
            want = brute.near_duplicates(rows, 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
        if name == "repeats":
            want = brute.repeats({r.doc_id: r.text for r in before.collect()}, corpus_pipeline.REPEATS.length)
            got = {r.doc_id: r.text for r in after.collect()}
            assert got.keys() == want.keys()
            assert all(n - gone - 6 * spans <= len((got[i] or "").encode()) <= n - gone for i, (n, gone, spans, _) in want.items())
        if name == "mixing":
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        if name == "packing":
            pieces_hold(after.collect(), [(r.doc_id, r.text) for r in before.collect()])
        else:
            assert after.columns == docs.columns
        before = after
    assert before.count() > 0


EXTRA = {"__score": 0.5, "__key": 1, "a.b": "x", "spans": "s", "row": 2, "key": 3, "epoch": 4, "shard": "t", "score": 0.1, "id": 5, "doc": 6, "_metadata": "m", "size": 7}


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and other columns with names like ours."""
    long = " ".join(f"w{i}" for i in range(30_000))
    base = spark.read.parquet(f"{brute.DATA}/documents.parquet").orderBy("doc_id").limit(25)
    rows = [tuple(r) for r in base.collect()]
    rows += [rows[0], rows[1], (rows[2][0], "another text of the same id", None, None, None)]
    rows += [(None, None, None, None, None), (None, rows[3][1], "en", "s", 1), (9001, None, None, None, None), (9002, "", "", "", 0), (9003, " \n", None, "s", 2), (9004, long, "en", None, len(long)), (9005, long + " w", "en", None, len(long) + 2)]
    docs = spark.createDataFrame(rows, brute.DOCS)
    for name, value in EXTRA.items():
        docs = docs.withColumn(name, F.lit(value))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, brute.DATA)
        if name == "packing":
            pieces_hold(after.collect(), [(r.doc_id, r.text) for r in before.collect()])
            continue
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        got = after.collect()
        assert all(r["a.b"] == "x" and r["__score"] == 0.5 and r["shard"] == "t" for r in got)
        if name == "near_duplicates":
            assert len({r.doc_id for r in got if r.doc_id is not None}) == sum(r.doc_id is not None for r in got)
        if name == "repeats":
            assert [r.doc_id for r in got] and all(r.n_chars == len(r.text) for r in got if r.text is not None)
        before = after
    for name, stage in corpus_pipeline.STAGES:  # an empty table
        assert stage(spark, docs.limit(0), brute.DATA).count() == 0


def test_hypergeometric_draws_of_any_size():
    """The rejection sampler against exact probabilities, and within its support where numpy can't draw."""
    rng = np.random.default_rng(5)
    for good, bad, draw in ((7, 9, 8), (40, 3, 20), (5, 200, 30)):
        n = np.bincount([mixing._log_concave(rng, good, bad, draw) for _ in range(6000)], minlength=draw + 1)
        want = np.array([math.comb(good, x) * math.comb(bad, draw - x) / math.comb(good + bad, draw) if draw - x >= 0 else 0.0 for x in range(draw + 1)])
        assert np.abs(n / 6000 - want).max() < 0.03
    x = [mixing._hypergeometric(rng, 4_000_000_000, 6_000_000_000, 5_000_000_000) for _ in range(50)]
    assert abs(np.mean(x) - 2e9) < 2e5 and len(set(x)) > 40
