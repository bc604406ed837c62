"""Language identification by words first, characters where a word is unknown.

A known word scores its log frequency in every language. An unknown word falls back to its character sequences of
four, and, only where none of them is known, of three, two and one; it scores their mean log frequency. A text takes
the language with the largest sum.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.arrow import give_back, pieces

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
SAMPLE_PER_LANGUAGE = 4000  # documents that a language's model is fitted on, at most
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_ORDER = 10_000
REMEMBERED = 200_000  # unknown words whose scores a task keeps
SALTS = 64
NONE = "und"


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]  # by place in ORDERS
    scores: np.ndarray  # one row per word or sequence, one column per language
    prior: int  # the language of most sampled documents


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lettered(words: list[str]) -> bool:
    return any(x.isalpha() for y in words for x in y)


def grams_of(word: str, order: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + order] for i in range(len(edged) - order + 1)] if order > 1 else list(word)


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, kind, item, n): kind 0 for words, else the order of a sequence, over all occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words: Counter = Counter()
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                words.update((lang, w) for w in words_of(text))
            out: Counter = Counter({(lang, 0, w): n for (lang, w), n in words.items()})
            for (lang, w), n in words.items():
                for order in ORDERS:
                    for g in grams_of(w, order):
                        out[lang, order, g] += n
            rows = [pa.array(x, t) for x, t in zip(zip(*((*k, n) for k, n in out.items())), (pa.string(), pa.int32(), pa.string(), pa.int64()))]
            if rows:
                yield pa.RecordBatch.from_arrays(rows, ["lang", "kind", "item", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, kind int, item string, n long")
    return counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, training: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from text and lang of a bounded sample: of each language, the `per_language` documents of smallest hash.

    Rows with null text or lang, and those that `training` excludes, teach nothing. The model's size is bounded by the
    numbers of words and sequences above.
    """
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.where(usable if training is None else usable & training)
    ids = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    for groups in (("lang", "salt"), ("lang",)):  # a language of very many documents is first cut down in parts
        first = Window.partitionBy(*groups).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language)
    chosen = ids.select("doc_id").distinct()
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    limit = F.when(F.col("kind") == 0, WORDS_PER_LANGUAGE).otherwise(GRAMS_PER_ORDER)
    ranked = _counts(sample).withColumn("total", F.sum("n").over(Window.partitionBy("lang", "kind")))
    top = ranked.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit).drop("nth").collect()
    languages = sorted({r["lang"] for r in top})
    place = {x: i for i, x in enumerate(languages)}
    index: dict[tuple[int, str], int] = {}
    for r in top:
        index.setdefault((r["kind"], r["item"]), len(index))
    seen = np.zeros((len(index), len(languages)))
    totals = np.ones((5, len(languages)))
    for r in top:
        seen[index[r["kind"], r["item"]], place[r["lang"]]] = r["n"]
        totals[r["kind"], place[r["lang"]]] = r["total"]
    kinds = np.array([k for k, _ in index], int)
    scores = np.log(seen + 0.5) - np.log(totals[kinds] + 0.5 * len(index)) if index else seen
    by_kind = [{item: i for (k, item), i in index.items() if k == kind} for kind in (0, *ORDERS)]
    size = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").first()
    return Model(languages, by_kind[0], by_kind[1:], scores, place.get(size["lang"], 0) if size else 0)


class Scorer:
    """A model with a bounded memory of unknown words."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places, self.table = dict(self.model.words), self.model.scores

    def _unknown(self, word: str) -> np.ndarray:
        for order, table in zip(ORDERS, self.model.grams):
            found = [table[g] for g in grams_of(word, order) if g in table]
            if found:
                return self.model.scores[found].mean(axis=0)
        return np.zeros(len(self.model.languages))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        words = set().union(*texts)
        if len(self.table) - len(self.model.scores) > REMEMBERED:
            self._forget()
        fresh = list(words.difference(self.places))
        if fresh:
            self.places.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
            self.table = np.concatenate([self.table, [self._unknown(w) for w in fresh]])
        places = self.places
        return np.array([self.table[[places[w] for w in words]].sum(axis=0) for words in texts])

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share."""
        words = [words_of(t or "") for t in texts]
        full = [i for i, w in enumerate(words) if self.model.languages and lettered(w)]
        names, shares = [NONE] * len(texts), [0.0] * len(texts)
        if full:
            sums = self.totals([words[i] for i in full])
            sums[(sums == sums[:, :1]).all(axis=1), self.model.prior] += 1e-9
            best = sums.argmax(axis=1)
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, x in zip(full, best.tolist(), share.tolist()):
                names[i], shares[i] = self.model.languages[k], min(1.0, x)
        return names, shares


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; neither lang nor any other column is looked at.

    `und` with score 0 for a null text or one without a letter, and for all if the model knows no language. A text of
    letters the model has never seen takes the most frequent language. Ties go to the first language by name. The
    score is the share of the chosen language if every language's sum is taken as a log likelihood.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for piece in pieces(batches):
            names, shares = scorer.judge(piece.column("text").to_pylist())
            columns = [piece.column("doc_id"), pa.array(names, pa.string()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the documents that are not held out."""
    model = fit(docs, ~held_out("doc_id"), per_language)
    found = predict(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame) -> DataFrame:
    """`docs` without the documents that have no language: null text, or no letter in it. Other columns pass through.

    If the model knows no language, letters alone decide.
    """
    model = fit(docs, ~held_out("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for piece in pieces(batches, limit=1 << 20):
            texts = piece.column("text").to_pylist()
            kept = [x != NONE for x in scorer.judge(texts)[0]] if model.languages else [lettered(words_of(t or "")) for t in texts]
            yield piece.filter(pa.array(kept, pa.bool_()))
        del scorer
        give_back()

    return docs.mapInArrow(run, docs.schema)
