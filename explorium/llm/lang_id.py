"""Language identification in two steps: the family first, then linear support vector machines inside it.

Texts become hashed counts of one- to four-byte sequences of their letters (lower case, everything in ASCII that is
no letter made a space), square-rooted and scaled to length 1. Families come from ``FAMILIES``; a language that isn't
listed is a family of its own. One linear machine per family, one against the rest, picks the family; inside it one
linear machine per pair of languages votes, ties going to the larger sum of margins and then to the name.

Training takes at most ``PER_LANGUAGE`` documents of each language (those of least seeded hash), the documented bound
of the labelled sample; prediction reads every whole text. A null text, or one without a letter, is ``und`` with
score 0, as is everything when nothing can be learned from. A single language learned is predicted throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Families of written languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn"),
}
PER_LANGUAGE, WIDTH, UNKNOWN = 500, 4096, "und"

_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def features(text: str) -> np.ndarray:
    """Of a whole text; long ones go through in blocks, whose counts add up."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" "
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, len(raw), 1 << 18):
        a = np.frombuffer(raw, np.uint8, min(len(raw) - at, (1 << 18) + 3), at).astype(np.uint32)
        code = a.copy()
        for n in range(1, 5):
            if n > 1:
                code = code[:-1] * np.uint32(257) + a[n - 1 :]
            # a sequence that starts in this block counts here; those of spaces only say nothing
            part = code[: 1 << 18]
            said = a[: len(part)] != 32
            part = part[said if n == 1 else said | (a[1 : len(part) + 1] != 32)]
            counts += np.bincount(((part + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=WIDTH)
    x = np.sqrt(counts)
    return (x / max(np.linalg.norm(x), 1e-9)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) of least ||w||^2 / 2 + c * mean squared hinge, by accelerated gradient steps. y: -1 or 1; classes weigh the same."""
    rows, x = x, np.ones((len(x), x.shape[1] + 1))  # double once, not in each product
    x[:, :-1] = rows
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = np.zeros(x.shape[1])
    ahead, t, rate = w, 1.0, 1.0 / (1 + 4 * c)  # rows have length at most sqrt(2)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * c * (x.T @ (weight * y * slack)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / s * (new - w), new, s
    return w


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    family_weights: dict[str, np.ndarray]
    pair_weights: dict[tuple[str, str], np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], known: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
        of = {lang: family for family, members in known.items() for lang in members}
        families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            families.setdefault(of.get(lang, f"={lang}"), []).append(lang)
        lang_of = np.array(langs)
        family_of = np.array([of.get(lang, f"={lang}") for lang in langs])
        upper = {f: linear_svm(x, np.where(family_of == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
        pairs = {}
        for members in families.values():
            for a, b in combinations(members, 2):
                rows = (lang_of == a) | (lang_of == b)
                pairs[a, b] = linear_svm(x[rows], np.where(lang_of[rows] == a, 1.0, -1.0))
        return cls(families, upper, pairs)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each row: the logistic of the family's lead times that of the weakest pair won."""
        if not self.families:
            return [(UNKNOWN, 0.0)] * len(x)
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        names = list(self.families)
        logistic = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -100, 100)))
        if self.family_weights:
            upper = np.stack([x @ self.family_weights[f] for f in names], axis=1)
            pick = upper.argmax(axis=1)
            lead = np.sort(upper, axis=1)
            sure = logistic((lead[:, -1] - lead[:, -2]) / 2)
        else:
            pick, sure = np.zeros(len(x), int), np.ones(len(x))
        margins = {p: x @ w for p, w in self.pair_weights.items()}
        out = []
        for i in range(len(x)):
            members = self.families[names[pick[i]]]
            votes = {m: [0, 0.0] for m in members}
            for a, b in combinations(members, 2):
                m = margins[a, b][i]
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
            best = min(members, key=lambda m: (-votes[m][0], -votes[m][1], m))
            weakest = min((margins[a, b][i] * (1 if a == best else -1) for a, b in combinations(members, 2) if best in (a, b)), default=None)
            out.append((best, float(sure[i] * (1.0 if weakest is None else logistic(weakest)))))
        return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = (t.as_py() for t in b.column(1))
        rows = [(lang, features(t).tobytes()) for lang, t in zip(b.column(0).to_pylist(), texts, strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """From rows with a language and a text. The sample is chosen on ids alone; whole texts are read only for it."""
    ids = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"))
    ids = ids.withColumn("__order", F.xxhash64("__id"))
    first = Window.partitionBy("__lang").orderBy("__order", "__id")
    chosen = ids.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_language).select("__id").distinct()
    # at most per_language ids of each language: a bounded table
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    got = sorted((r.lang, bytes(r.x)) for r in rows.select(lang_col, text_col).mapInArrow(_featured, "lang string, x binary").toLocalIterator())
    langs, x = [r[0] for r in got], np.empty((len(got), WIDTH), np.float32)
    for i in range(len(x)):
        x[i], got[i] = np.frombuffer(got[i][1], np.float32), None  # held once
    return LanguageModel.fit(x, langs)


def _told(texts: Iterable[str | None], model: LanguageModel) -> list[tuple[str, float]]:
    """Language and score of each text; one without letters is unknown."""
    texts = list(texts)
    said = [(UNKNOWN, 0.0)] * len(texts)
    if where := [i for i, t in enumerate(texts) if has_letter(t)]:
        for i, s in zip(where, model.predict(np.stack([features(texts[i]) for i in where])), strict=True):
            said[i] = s
    return said


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row. The model has WIDTH numbers per family and pair, so its size is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                said = _told((t.as_py() for t in b.column(1).slice(at, 256)), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learning from the labelled ones that aren't held out. A null id counts as not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is told, with their own columns. Each row is told by its own text, whatever its id."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out())))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                yield part.filter(pa.array([s[0] != UNKNOWN for s in _told((t.as_py() for t in part.column(at)), shared.value)], pa.bool_()))
        pa.default_memory_pool().release_unused()  # the process goes on to other tasks

    return docs.mapInArrow(run, docs.schema)
