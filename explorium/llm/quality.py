"""Quality of documents by co-training: one classifier reads the text, the other the metadata.

Both views start from the labelled documents. In each of ``ROUNDS`` rounds each view labels the unlabelled documents
it is surest of, as many of either class as its confidence allows, and both are trained again on what was gained. A
fifth of the labelled documents is kept from all of this; on it each view is calibrated (a logistic on its margin) and
a logistic over both calibrated margins combines them, so a view that knows nothing gets no say.

Training takes at most ``LABELLED`` labelled and ``UNLABELLED`` other documents (those of least hash), the documented
bounds of its sample. Every document is scored on its whole text. A text without words scores 0. Without labels of
both classes nothing can be learned and all scores are null. Rows that repeat an id are scored each; of repeated
labels of a document the least holds. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, UNLABELLED, ROUNDS, SURE, CUT = 4000, 4000, 4, 0.95, 0.5
_SIGNS = "!?#$%&*|@=<>{}[]~^_+/\\"


def text_features(text: str) -> list[float]:
    """Shares and means over the whole text: words, letters, signs, case, repetition, lines."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    signs = [text.count(c) for c in _SIGNS]
    trailing = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:)\"'")
    upper = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(len(words)) / 10, chars / n / 10, sum(signs) / chars * 10, trailing / n, upper / n,
        repeats / n, len(counts) / n, max(counts.values(), default=0) / n, max(pairs.values(), default=0) / n,
        sum(k - 1 for k in pairs.values()) / n, len(lines) / n, len(set(lines)) / max(len(lines), 1),
        text.count(".") / n, text.count(",") / n, sum(text.count(d) for d in "0123456789") / chars * 10,
        text.count("|") / n, text.count("!") / n, *(min(s / n, 3.0) for s in signs[:8]),
    ]


def meta_features(source: str | None, lang: str | None, n_chars: int | None, width: int = 64) -> list[float]:
    x = [0.0] * width
    x[zlib.crc32(f"s{source}".encode()) % (width - 8)] = 1.0
    x[width - 8 + zlib.crc32(f"l{lang}".encode()) % 4] = 1.0
    size = np.log1p(max(n_chars or 0, 0)) / 10
    x[-4:] = [size, size * size, float(n_chars is None), float(source is None)]
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights and bias (last) by Newton steps; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class QualityModel:
    scale: list[tuple[np.ndarray, np.ndarray]]
    views: list[np.ndarray]
    calibrations: list[np.ndarray]
    combined: np.ndarray
    gained: list[int]

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        z = [_margin((x - m) / s, w) for x, (m, s), w in zip(views, self.scale, self.views, strict=True)]
        c = [_margin(v[:, None], k) for v, k in zip(z, self.calibrations, strict=True)]
        return np.stack([_sigmoid(c[0]), _sigmoid(c[1]), _sigmoid(_margin(np.stack(c, axis=1), self.combined))], axis=1)


def co_train(views: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, sure: float = SURE) -> QualityModel | None:
    """y: 1, 0, or -1 for unlabelled; rows in a fixed order."""
    known = np.flatnonzero(y >= 0)
    kept, own = known[::5], np.setdiff1d(known, known[::5])
    if len(set(y[own])) < 2 or len(set(y[kept])) < 2:
        return None
    scale = [(x[known].mean(axis=0), x[known].std(axis=0) + 1e-6) for x in views]
    views = [(x - m) / s for x, (m, s) in zip(views, scale, strict=True)]
    label, gained = y.copy(), []
    label[kept] = -2
    share = max(0.05, min(0.95, y[own].mean()))
    for _ in range(rounds):
        told = np.full(len(y), -1)
        for x in views:  # each teaches what it is surest of, as many of a class as the labels have
            have = np.flatnonzero(label >= 0)
            p = _sigmoid(_margin(x, logistic(x[have], label[have])))
            free = np.flatnonzero((label == -1) & (told == -1))
            for value, sureness, part in ((1, p, share), (0, 1 - p, 1 - share)):
                most = int(np.ceil(part * 0.1 * len(own)))
                best = free[np.argsort(-sureness[free], kind="stable")][:most]
                told[best[sureness[best] >= sure]] = value
        new = told >= 0
        label[new] = told[new]
        gained.append(int(new.sum()))
        if not new.any():
            break
    have = np.flatnonzero(label >= 0)
    weights = [logistic(x[have], label[have]) for x in views]
    z = [_margin(x[kept], w) for x, w in zip(views, weights, strict=True)]
    calibrations = [logistic(v[:, None], y[kept], 1e-2) for v in z]
    both = np.stack([_margin(v[:, None], k) for v, k in zip(z, calibrations, strict=True)], axis=1)
    return QualityModel(scale, weights, calibrations, logistic(both, y[kept], 1e-2), gained)


def _features(texts: list[str | None], sources: list, langs: list, sizes: list) -> list[np.ndarray]:
    return [np.array([text_features(t or "") for t in texts]), np.array([meta_features(*m) for m in zip(sources, langs, sizes, strict=True)])]


_COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> QualityModel | None:
    """docs: doc_id, text, source, lang, n_chars; labels: doc_id, quality (0 or 1)."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    truth = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    joined = ids.join(truth, "doc_id", "left").withColumn("h", F.xxhash64("doc_id"))
    chosen = joined.where("y is not null").orderBy("h", "doc_id").limit(labelled).union(joined.where("y is null").orderBy("h", "doc_id").limit(unlabelled)).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text, meta = _features(*(c.to_pylist() for c in b.columns[2:]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], ["doc_id", "y", "a", "b"])

    # two bounded tables of ids
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce(F.col("y").cast("long"), F.lit(-1)).alias("y"), "text", "source", "lang", F.col("n_chars").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(tuple(r) for r in rows.mapInArrow(run, f"doc_id {kind}, y long, a binary, b binary").collect())
    if not got:
        return None
    order = sorted(got, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return co_train([np.stack([np.frombuffer(bytes(r[k])) for r in order]) for k in (2, 3)], np.array([r[1] for r in order]))


def score(docs: DataFrame, model: QualityModel | None, cut: float = CUT) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts, *meta = (c.to_pylist() for c in part.columns[1:])
                if shared.value is None:
                    p = [[None] * len(texts)] * 3
                else:
                    s = shared.value.scores(_features(texts, *meta))
                    s[[i for i, t in enumerate(texts) if not (t or "").split()]] = 0.0
                    p = s.T.tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.float64()) for c in p)], ["doc_id", "text_score", "meta_score", "score"])

    out = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long")).mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double")
    return out.withColumn("kept", F.coalesce(F.col("score") >= cut, F.lit(True)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
