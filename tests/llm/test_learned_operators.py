"""Chat layouts, language, quality and search."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import connect, differences
from awkward import nasty_rows
from pyspark.sql import functions as F

from duelgrid.llm import ann, chat, langid, quality_crf, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def test_chat_round_trip_of_control_strings(spark):
    bits = ["<|x", "<\\|", "<\\\\|<|", "a<", "\\n\n\\", "<<|im_end|>", "", "é<|im_start|>\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((a, b) for a in bits for b in bits)]
    rows += [(1, 100, "assistant", "é" + t) for t in bits]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.formatted(chat.canonical_turns(df, order_column="turn"))).first()
    want = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for _, _, r, t in want]
    assert back.loss_text == "".join(t for _, _, r, t in want if r == "assistant")


def test_chat_layouts_by_fingerprint(spark):
    schema = (
        "conv_id long, prompt string, response string, instruction string, input string, output string, system string, "
        "messages array<struct<role: string, content: string, weight: int>>, conversations array<struct<`from`: string, value: string>>, role_ string"
    )
    rows = [
        (1, "p", "r", None, None, None, None, None, None, "?"), (2, None, None, "i", "x", "o", "s", None, None, None),
        (3, None, None, "i", None, "o", None, None, None, None), (4, None, None, None, None, None, None, [("user", "a", 1), ("assistant", None, 0)], None, None),
        (5, None, None, None, None, None, None, None, [("human", "a"), ("gpt", "b")], None), (6, "p", "r", "i", None, None, None, None, None, None),
        (7, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    turns = collections.defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "nth").collect():
        turns[r.conv_id].append((r.role, r.text))
    assert dict(turns) == {
        1: [("user", "p"), ("assistant", "r")], 2: [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")], 3: [("user", "i"), ("assistant", "o")],
        4: [("user", "a"), ("assistant", "")], 5: [("user", "a"), ("assistant", "b")],
    }
    assert chat.layout_of(spark.createDataFrame([], "conv_id int, role string, text string, other int"))[0] == "turn"
    assert chat.layout_of(spark.createDataFrame([], "a int"))[0] is None


def test_chat_hash_is_sparks(spark):
    paths = ["messages[].role", "a.b", "z"]
    assert spark.range(1).select(F.xxhash64(F.lit("\n".join(sorted(paths))))).first()[0] == chat.path_hash(paths)


def test_chat_nulls_repeats_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(None, None, None, None, "x"), (1, 0, "assistant", "b", "x"), (1, 0, "assistant", "b", "x"), (1, None, "user", None, None)]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, schema), order_column="turn").collect()}
    assert got[None].n_turns == 1 and got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest() and got[1].loss_chars == 2
    assert chat.digests(spark.createDataFrame([], schema), order_column="turn").count() == 0


def held(doc, mod, rest):
    return doc is not None and zlib.crc32(str(doc).encode()) % mod == rest


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identified(docs, 200).collect()
    assert len(rows) == len(lang) and all(r.held_out == held(r.doc_id, 4, 2) for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(judged) / len(judged) > 0.98


def test_language_edges(spark, nasty, empty):
    model = langid.fit(spark.createDataFrame([(1, "the sun", "en"), (2, "der mond", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    scorer = langid.Scorer(model)
    names, shares = scorer.judge([None, "", "12 !?", "the", "sunder", "中文", "der der"])
    assert names[:4] == ["und", "und", "und", "en"] and names[5:] == ["de", "de"] and shares[0] == 0 and 0.5 <= shares[3] <= 1
    nobody = langid.fit(empty)
    assert langid.Scorer(nobody).judge(["abc"]) == (["und"], [0.0])
    got = langid.recognised(nasty)
    has_letter = [t for _, t in nasty_rows() if t and any(c.isalpha() for c in t)]
    assert got.count() == len(has_letter) and got.columns == nasty.columns and langid.identified(empty).count() == 0


def test_language_falls_back_to_shorter_sequences():
    model = langid.Model(["a", "b"], {}, [{}, {}, {"xy": 0}, {"q": 1}], np.array([[-1.0, -5.0], [-9.0, -2.0]]), 0)
    assert langid.Scorer(model).judge(["xyq", "qq"])[0] == ["a", "b"]


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_crf.scored(docs, labels).collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]
    assert sum(judged) / len(judged) > 0.95


def test_quality_edges(spark, nasty, empty):
    labels = spark.createDataFrame([(20, 1), (22, 1), (25, 0), (26, 1), (24, None), (None, 0)], "doc_id long, quality int")
    rows = quality_crf.scored(nasty, labels).collect()
    assert len(rows) == len(nasty_rows()) and all(np.isfinite(r.score) for r in rows)
    assert quality_crf.scored(empty, labels).count() == 0
    nobody = quality_crf.scored(nasty, labels.limit(0)).collect()
    assert {r.score for r in nobody} == {0.5}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    odds, moves, lengths = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([4, 0, 1, 2])
    good, pairs = quality_crf.marginals(odds, lengths, moves)
    want, joint, first = [], np.zeros((2, 2)), 0
    for n in lengths:
        u = odds[first : first + n]
        first += n
        ways = [[k >> i & 1 for i in range(n)] for k in range(1 << n)] if n else []
        weight = np.array([np.exp(sum(u[i] * y[i] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n))) for y in ways])
        want += [float(sum(w for w, y in zip(weight, ways) if y[i]) / weight.sum()) for i in range(n)]
        for w, y in zip(weight, ways):
            for i in range(1, n):
                joint[y[i - 1], y[i]] += w / weight.sum()
    assert np.allclose(good, want) and np.allclose(pairs, joint)


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_equal_plain_counts(spark, nasty):
    rng = random.Random(4)
    more = [(100 + i, "".join(rng.choice(["a", "b", "c", "#", " ", " ", "\n", "\r", "|"]) for _ in range(n))) for i, n in enumerate([0, 3, 9, 40, 400] * 8)]
    docs = nasty.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((tuple(r) for r in quality_rules.base_counts(docs).drop("text").collect()), key=repr)
    assert got == sorted(((d, *plain_counts(t)) for d, t in nasty_rows() + more), key=repr)


def plain_buckets(spark, text):
    tokens = re.findall(r"[^\W\d_]+|\d+|(?:(?![^\W\d_]|\d)[^\x20\x09-\x0d])+", text)
    keys = [(t,) for t in tokens] + list(zip(tokens, tokens[1:]))
    return [spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(x) for x in k]), F.lit(quality_rules.BUCKETS))).first()[0] for k in keys]


def test_log_ratios_by_hand(spark):
    good, bad = "sun moon sun", "## !! ##"
    docs = spark.createDataFrame([(1, good), (2, bad), (3, None), (1, good)], "doc_id long, text string")
    ratios = quality_rules.log_ratios(docs, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long"))
    g, b, n = plain_buckets(spark, good), plain_buckets(spark, bad), quality_rules.BUCKETS
    for k in {*g, *b}:
        raw, target = 2 * g.count(k) + b.count(k), 2 * g.count(k)
        assert ratios[k] == pytest.approx(np.log((target + 1) / (10 + n) / ((raw + 1) / (15 + n))), abs=1e-6)
    row = {r.doc_id: r for r in quality_rules.judged(docs, docs.where("doc_id = 1")).collect()}
    assert row[1].llr == pytest.approx(np.mean([ratios[k] for k in g])) and row[3].llr == 0 and not row[3].kept


def test_quality_rules_part_labels(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judged(docs, labels.where("quality = 1")).join(labels, "doc_id").collect()
    assert all(r.kept == (r.quality == 1) for r in rows if not r.base_failed)
    nobody = quality_rules.judged(docs, labels.limit(0)).where("NOT base_failed AND NOT kept")
    assert nobody.count() == 0 and quality_rules.judged(empty, empty).count() == 0


def test_search_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = vectors.toPandas()
    x, ids = np.array(pdf.embedding.tolist(), float), pdf.vec_id.to_numpy()
    got = collections.defaultdict(list)
    for r in ann.search(vectors, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids if i % 20 == 0)
    place, hit = {i: n for n, i in enumerate(ids)}, 0
    for q, found in got.items():
        scores = (x * x[place[q]]).sum(axis=1)
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hit += len({i for i, _ in found} & set(best))
        assert len(found) == 20 and all(s == pytest.approx(scores[place[i]], abs=1e-12) for i, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hit / (20 * len(got)) >= 0.95


def test_search_ties_repeats_and_bad_vectors(spark):
    one, two = [1.0, 0.0, 2.0], [0.5, -1.0, 0.0]
    rows = [(i, one) for i in range(0, 60)] + [(0, one), (100, two), (101, [0.0] * 3), (102, None), (103, [1.0, None, 0.0]), (104, [1.0, float("nan"), 0.0])]
    rows += [(105, [1.0, float("inf"), 0.0]), (None, one), (120, [1.0, 2.0]), (140, [])]
    df = spark.createDataFrame([(i, v, 0.0, 1) for i, v in rows], "vec_id long, embedding array<double>, score double, id int")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40, 100]
    for q in (0, 20, 40):
        assert [(n, i) for n, i, _ in got[q]] == list(enumerate([i for i in range(22) if i != q][:20], 1)) and {s for _, _, s in got[q]} == {5.0}
    assert [i for _, i, _ in got[100]] == list(range(20)) and got[100][0][2] == 0.5
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_chi_square_quantile():
    assert ann.chi_square_quantile(2, 0.95) == pytest.approx(5.991, abs=1e-3) and ann.chi_square_quantile(8, 0.97) == pytest.approx(17.01, abs=1e-2)


def test_texts_stay_when_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "the sun", None), (None, "mond", None), (3, "12 !?", None), (4, None, None), (5, "", None)], "doc_id long, text string, lang string")
    assert {r.text for r in langid.recognised(docs).collect()} == {"the sun", "mond"}
