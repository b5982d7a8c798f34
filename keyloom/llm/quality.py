"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text is a bag of hashed features of its whole length: words, the shapes of
words and of their ends, and whether words repeat.  A bounded sample of labelled
texts fits a weighting of rare features and a truncated singular value
decomposition, and its vectors, with their labels, are broadcast.  Every document
is projected and its cosine to every labelled vector computed in blocks; the
``NEIGHBOURS`` nearest vote with weights that grow with similarity and with the
number of labelled texts that each stands for.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import by_size, crc_mod, one_thread, stable

#: Labelled texts of each label that are learned from, at most (those of the
#: smallest hash of their id); all labels serve if there are fewer.
SAMPLE = 1024
WORD_FEATURES = 1024
SHAPE_FEATURES = 1024
FEATURES = WORD_FEATURES + SHAPE_FEATURES
RANK = 48
NEIGHBOURS = 25
#: Weight of a neighbour of cosine c: max(c, 0) to this power.
SHARPNESS = 8
#: Documents whose products are computed at once.
ROWS = 512
THRESHOLD = 0.3
#: Words remembered by a worker; the memory is emptied when full.
MEMORY = 200_000


class Features(dict):
    """word -> (feature of the word, feature of its shape)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= MEMORY:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip("".join(sorted({c for c in text if not c.isalnum()})))
        case = "u" if core.isupper() and len(core) > 1 else "t" if core[:1].isupper() else "l" if core.islower() else "d" if core.isdigit() else "m"
        ends = "".join(c for c in text if not c.isalnum())[-4:]
        shape = f"{case}{min(len(core), 24) // 6}{ends}"
        self[word] = out = (zlib.crc32(text.lower().encode("utf-8", "replace")) % WORD_FEATURES, WORD_FEATURES + zlib.crc32(shape.encode("utf-8", "replace")) % (SHAPE_FEATURES - 16))
        return out


def counts(text: str | None, memory: Features) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs; the last 16 are of the whole.

    Of the whole: the share of words that repeat the word before, in steps, and
    whether there are none.
    """
    words = (text or "").encode("utf-8", "replace").split()
    n = len(words)
    if not n:
        return np.array([FEATURES - 1]), np.ones(1)
    by_word = Counter(words)
    ids = np.zeros(FEATURES)
    pairs = np.array([memory[w] for w in by_word])
    times = np.fromiter(by_word.values(), np.float64, len(by_word))
    ids += np.bincount(pairs.ravel(), np.repeat(times, 2), FEATURES)
    again = sum(a == b for a, b in pairwise(words)) / n
    ids[FEATURES - 16 + min(7, int(16 * again))] += n
    found = np.flatnonzero(ids)
    return found, ids[found]


@dataclass
class Model:
    """Feature weights, projection, labelled unit vectors, labels, their mean, and how
    many labelled texts each vector stands for."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    stands: np.ndarray

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _unit(weighted(rows, self.weights) @ self.projection)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The weighted share of label 1 among each row's nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        near = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** SHARPNESS * self.stands[top]
        total = weight.sum(1)
        votes = (weight * self.labels[top]).sum(1)
        return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior), 0.0, 1.0)


def weighted(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Rows of damped, weighted counts; words and shapes each of length one."""
    out = np.zeros((len(rows), FEATURES), np.float32)
    for i, (ids, times) in enumerate(rows):
        out[i, ids] = np.log1p(times)
    out *= weights
    out[:, :WORD_FEATURES] = 0.5 * _unit(out[:, :WORD_FEATURES])
    out[:, WORD_FEATURES:] = _unit(out[:, WORD_FEATURES:])
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows**2).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray) -> Model:
    """The model of labelled rows; ``weight`` is how many labelled texts a row stands for."""
    if not rows:
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5, weight)
    seen = np.zeros(FEATURES)
    for ids, _ in rows:
        seen[ids] += 1
    weights = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    matrix = weighted(rows, weights)
    _, _, right = np.linalg.svd(matrix, full_matrices=False)
    projection = np.ascontiguousarray(right[:RANK].T)
    return Model(weights, projection, _unit(matrix @ projection), labels.astype(np.float64), float((labels * weight).sum() / weight.sum()), weight)


def _featured(texts: DataFrame, columns: str) -> DataFrame:
    """The columns with ids and times of each text's features."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Features()
        for frame in frames:
            found = [counts(t, memory) for t in frame["text"]]
            yield frame[names].assign(ids=[i.astype(np.int32) for i, _ in found], times=[t.astype(np.float32) for _, t in found])

    return texts.mapInPandas(run, f"{columns}, ids array<int>, times array<float>")


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, quality, stands of at most ``sample`` training rows of each label.

    Chosen are each label's rows with the smallest hash of doc_id; stands: the
    label's training rows for each one chosen.  The ids are at most twice
    ``sample``, so they are broadcast to the documents.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(crc_mod(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    size = known.groupBy("quality").agg(F.count("*").alias("n"))
    ids = stable(chosen[0].unionAll(chosen[1]).join(F.broadcast(size), "quality").select("doc_id", "quality", (F.col("n") / F.least("n", F.lit(sample))).alias("stands")))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "stands").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on a bounded sample, in one task; only the model reaches the driver."""
    featured = _featured(labelled(docs, labels, sample), "doc_id long, quality int, stands double")

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        rows = list(zip(frame["ids"], frame["times"], strict=True))
        model = fit(rows, frame["quality"].to_numpy(np.float64), frame["stands"].to_numpy(np.float64))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    held = featured.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "model binary").first()
    return pickle.loads(held.model) if held else fit([], np.zeros(0), np.zeros(0))


def score(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` (any columns, among them text) with the column ``quality_score``.

    A column of that name is replaced.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_thread()
        memory, use = Features(), shared.value
        for batch in batches:
            rows = (counts(t, memory) for t in batch)
            parts = [use.scores(held) for held in by_size(rows, lambda _: 1, ROWS)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return texts.withColumn("quality_score", scores("text"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    scored = score(docs.select(own).select("own", F.col("own.text").alias("text")), model)
    return scored.where(F.col("quality_score") >= threshold).select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    Needs doc_id and text of ``docs`` and doc_id and quality of ``labels``; other
    columns are ignored, whatever their names.  Learns from labelled rows whose
    crc32 of the decimal doc_id is not divisible by 5; the others are held out.
    Scores depend on the text alone.  A null text is empty and a null id counts as
    the text ''; both get a score.  Of several labels of one id the least counts,
    of several texts the least.  Without labels every score is 0.5.  Repeated rows
    each get a row; an empty table gives none.
    """
    model = train(docs, labels, sample)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= threshold, 1).otherwise(0).alias("predicted"))
