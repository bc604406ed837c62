"""A quality score from a linear-chain conditional random field over the lines of a text.

Every line with a word is labelled good or bad. A line's evidence is its own features and those of the lines before
and behind it; a matrix of two by two weighs neighbouring labels. Forward-backward gives each line's marginal of being
good, and their mean, weighted by line length, is the text's share of good text. One logistic curve over that share,
fitted on the same training texts, makes it a probability.

The field is trained on a bounded sample of labelled texts, each line carrying its text's label, by gradient ascent on
the penalised likelihood. Scoring looks at the text alone, whole, in bounded memory, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.arrow import SPACE, as_bytes, joined, pieces, word_bounds, word_hashes

SAMPLE_DOCUMENTS = 3000  # labelled texts that the field is trained on, at most
ROUNDS, RATE, PENALTY = 150, 0.2, 1e-3

# Classes of bytes whose shares in a line are features; bytes above 127 belong to letters outside ASCII.
CLASSES = (
    range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1), range(ord("0"), ord("9") + 1),
    b"#*$%&|<>@^~=+_\\/{}[]", b"!?", b".,;:'\"()-", range(128, 256),
)
FEATURES = len(CLASSES) + 6


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features of a line, the one before, the one behind, and a constant
    moves: np.ndarray  # [label before, label]
    curve: tuple[float, float]
    prior: float


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, text number) of every line that has a word, in order."""
    data, starts = joined(texts)
    ends = np.flatnonzero(data == 10) + 1
    begins = np.concatenate([[0], ends[:-1]])
    words, word_ends = word_bounds(data)
    first = np.searchsorted(words, begins)
    count = np.searchsorted(words, ends) - first
    real = np.flatnonzero(count > 0)
    begins, ends, first, count = begins[real], ends[real], first[real], count[real]
    if len(real) == 0:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(0, np.int64)
    size = (ends - begins).astype(float)
    cuts = np.column_stack([begins, ends]).ravel()[:-1]  # every second stretch is a line
    out = np.zeros((len(real), FEATURES), np.float32)
    table = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES):
        table[list(members)] = k
    classes = table[data]
    for k in range(len(CLASSES)):
        out[:, k] = np.add.reduceat(classes == k, cuts, dtype=np.int64)[::2] / size
    hashes = word_hashes(data, words, word_ends)
    same = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]), out=same[1:])
    inside = np.minimum(first + 1, first + count)
    k = len(CLASSES)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    out[:, k + 2] = np.minimum((word_ends[first + count - 1] - words[first]) / count, 50) / 10
    out[:, k + 3] = (same[first + count] - same[inside]) / count
    last = data[word_ends[first + count - 1] - 1]
    out[:, k + 4] = np.isin(last, np.frombuffer(b".!?:\"'", np.uint8))
    opening = data[words[first]]
    out[:, k + 5] = ((opening >= 65) & (opening <= 90)) | (opening >= 128)
    letters = (data & 0xC0) != 0x80
    length = np.add.reduceat(letters & ~SPACE[data], cuts, dtype=np.int64)[::2].astype(float)
    return out, length, np.searchsorted(starts, begins, side="right") - 1


def with_neighbours(features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and behind (zeros at a text's ends), and a constant."""
    n, k = features.shape
    out = np.zeros((n, 3 * k + 1))
    out[:, :k], out[:, -1] = features, 1
    if n > 1:
        joins = (text[1:] == text[:-1])[:, None]
        out[1:, k : 2 * k] = features[:-1] * joins
        out[:-1, 2 * k : 3 * k] = features[1:] * joins
    return out


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, expected label pairs summed over all texts).

    `odds` has each line's evidence, text after text, `lengths` the lines per text. All texts advance side by side,
    longest first, so that the running ones are always the first rows.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    score = np.column_stack([np.zeros(len(odds)), odds])
    ahead, behind = score.copy(), np.zeros_like(score)
    for t in range(1, steps):
        at = first[: active[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
    for t in range(steps - 1, 0, -1):
        at = first[: active[t]] + t
        coming = score[at] + behind[at]
        behind[at - 1] = np.logaddexp(coming[:, :1] + moves[:, 0], coming[:, 1:] + moves[:, 1])
    joint = ahead + behind
    total = np.logaddexp(joint[:, 0], joint[:, 1])
    good = np.exp(joint[:, 1] - total)
    inner = np.ones(len(odds), bool)
    inner[first[sizes > 0]] = False
    at = np.flatnonzero(inner)
    paired = ahead[at - 1][:, :, None] + moves + (score[at] + behind[at])[:, None, :] - total[at][:, None, None]
    return good, np.exp(paired).sum(axis=0)


def _share(good: np.ndarray, length: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Mean of `good` by text, weighted by length; NaN for a text without lines."""
    weight = np.bincount(text, weights=length, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(text, weights=good * length, minlength=n) / weight


def _logit(share: np.ndarray) -> np.ndarray:
    p = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(features: np.ndarray, length: np.ndarray, text: np.ndarray, label: np.ndarray) -> Field:
    """Gradient ascent with Adam's step sizes; `label` is each text's 0 or 1."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = with_neighbours((features - mean) / scale, text)
    lengths = np.bincount(text, minlength=len(label))
    y = label[text].astype(float)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = np.maximum(lengths[label == k] - 1, 0).sum()
    w, moves, n = np.zeros(x.shape[1]), np.zeros((2, 2)), max(len(y), 1)
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for step in range(1, ROUNDS + 1):
        good, pairs = marginals(x @ w, lengths, moves)
        gradient = np.concatenate([x.T @ (y - good) / n - PENALTY * w, ((seen - pairs) / n - PENALTY * moves).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    good, _ = marginals(x @ w, lengths, moves)
    share = _share(good, length, text, len(label))
    there = ~np.isnan(share)
    z, t = _logit(share[there]), label[there]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps for the curve, with a small penalty that keeps separable samples finite
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((t - p) * z).sum() - 0.1 * (a - 1), (t - p).sum() - 0.1 * b])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    return Field(mean, scale, w, moves, (float(a), float(b)), float(label.mean()))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCUMENTS) -> Field | None:
    """The field of the labelled texts that are not held out: the `limit` of smallest hash; None without any.

    Only features come to the driver: about 60 bytes for each line of a sampled text.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = [line_features([t]) for t in as_bytes(piece.column("text"))]
            columns = [piece.column("doc_id"), piece.column("label"), pa.array([f.tobytes() for f, _, _ in rows], pa.binary()), pa.array([n.tobytes() for _, n, _ in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "features", "lengths"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(describe, f"doc_id {kind}, label int, features binary, lengths binary").collect()
    rows = sorted(((r["doc_id"], r["label"], bytes(r["features"]), bytes(r["lengths"])) for r in rows))
    if not rows:
        return None
    features = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    length = np.concatenate([np.frombuffer(r[3]) for r in rows])
    if not len(length):
        return None
    text = np.repeat(np.arange(len(rows)), [len(f) for f in features])
    return train(np.concatenate(features).astype(float), length, text, np.array([r[1] for r in rows]))


def score_texts(texts: list[bytes], field: Field) -> np.ndarray:
    features, length, text = line_features(texts)
    out = np.full(len(texts), field.prior)
    if len(length):
        x = with_neighbours((features - field.mean) / field.scale, text)
        lengths = np.bincount(text, minlength=len(texts))
        good, _ = marginals(x @ field.weights, lengths, field.moves)
        share = _share(good, length, text, len(texts))
        there = ~np.isnan(share)
        out[there] = 1 / (1 + np.exp(-(field.curve[0] * _logit(share[there]) + field.curve[1])))
    return out


def scored(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of every whole text.

    A null text, or one without a word, scores the share of label 1 in the sample; without any labelled text every
    score is 0.5. Repeated rows give repeated rows; labels, lang, source and doc_id play no part in a score.
    """
    field = fit(docs, labels, limit)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = as_bytes(piece.column("text"))
            score = score_texts(texts, field) if field else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
