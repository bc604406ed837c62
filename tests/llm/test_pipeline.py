"""The pipeline against its stages' definitions, on a small table."""

import collections
import os
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from awkward import nasty_rows, prose
from test_text_operators import plain_components, plain_fingerprint, plain_spans
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402

from duelgrid.llm import secret_scan  # noqa: E402


def plain_pipeline(rows):
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    rows = sorted({d: (d, t) for d, t in rows}.values(), key=lambda r: r[0])
    first = plain_components([plain_fingerprint(t) for _, t in rows])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    split = [re.findall("[^\x20\x09-\x0d]+", t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for (d, t), w in zip(rows, split):
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        clean, done = "", 0
        for s, kind, e in plain_spans(text):
            if s >= done:
                clean += text[done:s] + f"[{secret_scan.RULES[kind].kind}]"
            done = max(done, e)
        out.append((d, clean + text[done:]))
    return out


def test_pipeline_equals_its_definition(spark, tmp_path):
    rows = [r for r in nasty_rows() if r[0] is not None]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in plain_pipeline(rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = range(0, len(ids), 1024)
        want[d] = [(s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in cuts]
    assert {d: sorted(x) for d, x in got.items()} == want


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").dtypes == docs.dtypes


def test_documents_without_id_or_with_a_shared_id_reach_the_end(spark, tmp_path):
    alone = [prose(60 + i, 80) for i in range(6)]
    rows = [*((None, t) for t in alone[:4]), (None, alone[0]), (7, alone[4]), (7, alone[5]), *((i, prose(i, 60)) for i in range(100, 110))]
    docs = [(d, t, "en", "s", len(t)) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = sorted(((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(d, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")) for d, t in dict.fromkeys(rows)]
    assert max(len(x) for _, x in ids) <= 1024
    assert got == sorted(((d, zlib.crc32(x.tobytes())) for d, x in ids), key=repr)
