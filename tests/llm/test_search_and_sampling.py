"""Exact top-k, source divergence and resampling: each against a plain reading of its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from awkward import nasty_rows, prose
from pyspark.sql import functions as F

from duelgrid.llm import divergence, resampling, topk

VECTORS = "vec_id long, embedding array<double>, cls string, cell int, part int, side int, nth int"


def vector_table(spark, rows):
    floats = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, "c", 1, 1, 1, 1) for i, v in floats], VECTORS).repartition(3)


def plain_topk(rows, every, k):
    usable = {(i, tuple(math.floor(Fraction(x) * 256) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in usable:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if len(v) == len(q) and (j, v) != (i, q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near[:k])]
    return sorted(out)


def found(table, every=5, k=5):
    return sorted(map(tuple, topk.search(table, F.col("id") % every == 0, k).collect()))


@pytest.fixture
def small_segments(monkeypatch):
    """Many segments, tiles and copies on a small table."""
    monkeypatch.setattr(topk, "SEGMENT_NUMBERS", 200)
    monkeypatch.setattr(topk, "TILE_QUERIES", 7)
    monkeypatch.setattr(topk, "TILE_SEGMENTS", 3)
    monkeypatch.setattr(topk, "ASKED_OF_COPY", 4)


def test_topk_of_ties_copies_and_odd_vectors(spark, small_segments):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).round(1).tolist()) for i in range(120)]
    rows += [(200 + i, [0.0] * 6) for i in range(9)] + [(300 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(40)]  # all tied
    rows += [(500, None), (505, [1.0, None, 0, 0, 0, 0]), (510, [math.inf] * 6), (515, [math.nan] * 6), (None, [1.0] * 6)]
    rows += [(600, [0.5, 0.25]), (605, [0.5, -0.25]), (606, [-3.0, 9.0]), (700, []), (701, []), (800, [2.0, 2.0, 2.0])]
    rows += [(900, [0.1] * 6), (900, [0.1] * 6), (900, [-0.1] * 6), (0, rows[0][1])]
    assert found(vector_table(spark, rows)) == plain_topk(rows, 5, 5)


def test_topk_of_large_numbers_is_exact(spark):
    rows = [(i, [2.0 ** (14 + i), -(2.0**18) - i, 1.0 + i]) for i in range(8)]
    assert found(vector_table(spark, rows), 2, 3) == plain_topk(rows, 2, 3)
    beyond = [(0, [1e300, -1e300]), (1, [1e300, 1e200]), (2, [-1e300, 0.0]), (3, [1e30, 3.0])]
    top = 2**63 - 1  # components and scores stop there
    assert found(vector_table(spark, beyond), 2, 2) == [(0, 1, 3, top), (0, 2, 1, -top), (2, 1, 0, -top - 1), (2, 2, 1, -top - 1)]


def test_topk_of_an_empty_table(spark):
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(vector_table(spark, [(0, [1.0, 2.0])])) == []


def test_blocks_whose_bound_is_too_low_are_not_scored():
    """Clustered vectors: the answer is that of a full scan, and most blocks of the segment are never scored."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    vectors = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + 0.05 * rng.standard_normal((8000, 32)))).astype(np.int64)
    segment = topk.Segment(vectors, np.arange(8000))
    asked = vectors[:200]
    who, where, score, scored = segment.best(asked, [None] * 200, 6)
    order = np.lexsort((np.broadcast_to(np.arange(8000), (200, 8000)), -(asked @ vectors.T)), axis=1)[:, :6]
    assert where.reshape(200, 6).tolist() == order.tolist()
    assert scored < 0.25 * 200 * len(segment.starts)


# -- divergence ---------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, ranks=200):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(CAPITALS))
        counts[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= 3]
        sources = [s for la, s in counts if la == lang]

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -value, n + 1) for n, (value, item) in enumerate(found)]
    return sorted(out)


def source_rows():
    rng = random.Random(4)
    rows = [(prose(i, rng.choice([3, 40, 300])), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", None])) for i in range(60)]
    rows += [(t, "en", "odd") for _, t in nasty_rows()] + rows[:5]
    rows += [("", "xx", "a"), (None, "xx", "b"), ("1 2 3", "xx", None), ("lone", "yy", "only"), ("ÀÉ ÀÉ àé ſ", "zz", "a"), ("ÀÉ", "zz", "b"), ("ÀÉ\x00é", "zz", "b")]
    return rows


SOURCES = "text string, lang string, source string, term string, n long, shard int, salt long, gid long, p string"


@pytest.mark.parametrize(("block", "fan_in"), [(250_000, 64), (40, 3)])
def test_divergence_equals_plain_sums(spark, monkeypatch, block, fan_in):
    """Once as one run per task, once with many spilled runs that take several merges."""
    rows = source_rows()
    found = divergence.frequencies
    monkeypatch.setattr(divergence, "frequencies", lambda docs, fewest: found(docs, fewest, block, fan_in))
    monkeypatch.setattr(divergence, "STEP_BYTES", 64)
    monkeypatch.setattr(divergence, "PAIRS", 50)
    docs = spark.createDataFrame([(*r, "t", 1, 2, 3, 4, "p") for r in rows], SOURCES).repartition(4)
    assert sorted(map(tuple, divergence.audited(docs).collect())) == plain_audit(rows)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audited(spark.createDataFrame([], SOURCES)).count() == 0


def test_pieces_of_a_text_cut_no_term():
    text = ("ab é" * 50 + " " + "x" * 300 + "9" + "y").encode()
    old, divergence.STEP_BYTES = divergence.STEP_BYTES, 7
    try:
        parts = list(divergence.parts_of(text))
    finally:
        divergence.STEP_BYTES = old
    assert b"".join(parts) == text and [t for p in parts for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)


# -- resampling ---------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall((text or "").translate(CAPITALS))
    return len(words), words + [" ".join(x) for x in zip(words, words[1:])]


def plain_resampling(rows, target):
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for i, (doc, text) in enumerate(rows):
        n_words, found = plain_features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None])
        if n_words >= 20:
            able.append((-score, doc is None, doc or 0, len(found), i))
    for nth, (*_, i) in enumerate(sorted(able)[: 25 * len(able) // 100]):
        out[i][4] = nth + 1
    return sorted(map(tuple, out), key=repr)


def document_rows():
    rng = random.Random(6)
    rows = [*nasty_rows(), *((100 + i, prose(50 + i, rng.choice([5, 19, 20, 21, 200]))) for i in range(80)), *[(7, prose(3, 90))] * 30]
    return rows + [(400, "Z" * 300_000 + " tail " + "q" * 5000), (401, ("word " * 30 + "é" * 70_000 + ". ") * 3)]


DOCUMENTS = "doc_id long, text string, score string, weight long, range int, place long, nth long, n_words string"


def test_resampling_equals_plain_draw(spark):
    rows, target = document_rows(), [prose(900, 60), None, "", "the river of stone"]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "n") for r in rows], DOCUMENTS).repartition(5)
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resampling.resampled(docs, aim).collect()
    assert sorted(map(tuple, got), key=repr) == plain_resampling(rows, target)
    none = resampling.resampled(docs, aim.limit(0))
    assert sorted(map(tuple, none.collect()), key=repr) == plain_resampling(rows, [])
    assert resampling.resampled(docs.limit(0), aim).count() == 0


def test_checksums_of_all_runs_of_words():
    rng = random.Random(8)
    texts = [prose(i, rng.choice([1, 2, 30, 3000])).encode() for i in range(40)] + [b"", b"x" * 200_000 + b" yy " + b"z" * 70]
    bucket, owner, n_words = resampling.features(texts, 2**31, 4)
    for i, text in enumerate(texts):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
        want = Counter(zlib.crc32(b" ".join(words[j : j + n])) % 2**31 for n in range(1, 5) for j in range(len(words) - n + 1))
        assert Counter(bucket[owner == i].tolist()) == want and n_words[i] == len(words)


def test_long_words_of_one_polynomial_stay_apart(spark):
    """Two words of a Thue-Morse sequence and its complement collide in any polynomial modulo 2^64."""
    from duelgrid.llm import substring

    bits = [bin(i).count("1") % 2 for i in range(4096)]
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    rows = [(i, " ".join([w, *(f"w{k}" for k in range(34))]), 1, "x") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, n_chars string").select("doc_id", "text", "bucket")
    assert [r["n_removed"] for r in substring.removed(docs).collect()] == [0, 0]
    assert sorted(map(tuple, substring.cleaned(docs).collect())) == [r[:3] for r in rows]


@pytest.mark.parametrize("kind", ["equal", "binary"])
def test_nearest_ties_go_to_the_smaller_id(spark, kind):
    from duelgrid.llm import ann

    rng = np.random.default_rng(1)
    ids = rng.permutation(400).tolist()
    vectors = [[1.0, *rng.standard_normal(7).round(3).tolist()] if kind == "equal" else rng.integers(0, 2, 8).astype(float).tolist() for _ in ids]
    if kind == "equal":
        vectors[ids.index(0)] = [1.0] + [0.0] * 7
    table = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.search(table, F.col("id") == 0).orderBy("rank").collect()]
    own = vectors[ids.index(0)]
    near = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in zip(ids, vectors) if i != 0 and any(v))
    assert got == [i for _, i in near[:20]] if any(own) else got == []


def test_records_of_mixed_layouts_keep_those_with_null_answers(spark):
    from duelgrid.llm import chat

    rows = [(1, "ask", None, None, None), (2, None, None, "do", None), (3, "ask", "say", None, None), (4, None, None, "do", "done"), (5, None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, prompt string, response string, instruction string, output string")
    turns = chat.canonical_turns(table).groupBy("conv_id").agg(F.count("*").alias("n")).collect()
    assert {r["conv_id"]: r["n"] for r in turns} == {1: 2, 2: 2, 3: 2, 4: 2}
