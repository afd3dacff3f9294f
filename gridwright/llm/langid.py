"""Language identification by a string kernel.

A text's features are which of its n-grams of UTF-8 bytes occur (blended spectrum: several n together), whole text,
lower case, filed by a hash among DIMS places. The kernel of two texts is the number of places they share over the root
of the product of their numbers of places. Nyström: a text is described by its kernel values with landmark texts, times
the inverse root of the landmarks' own kernel matrix; kernel ridge regression of one language against the rest is then
linear in these, and a batch is scored by two matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

DIMS = 1 << 13
SIZES = (1, 2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def presence(text: str, into: np.ndarray, piece: int = 1 << 18) -> None:
    """Mark the places of a text's n-grams in a row."""
    b = np.frombuffer(text.lower().encode(), np.uint8)
    for k in range(0, len(b), piece):
        part = b[max(0, k - max(SIZES) + 1) : k + piece].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(SIZES) + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            code = (code[:m] << np.uint32(8)) | part[n - 1 :]
            if n in SIZES:
                into[((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)] = 1


def features(texts: list[str]) -> np.ndarray:
    """Presence rows of unit length."""
    x = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        presence(t, x[i])
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Model:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], landmarks: int = 24, ridge: float = 1e-2) -> Model:
        """From labelled texts; so many landmarks of each language, the first given."""
        languages = sorted(set(langs))
        x, y = features(texts), np.array(langs)
        marks = x[np.concatenate([np.flatnonzero(y == g)[:landmarks] for g in languages])]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.hstack([(x @ marks.T).astype(np.float64) @ root, np.ones((len(x), 1))])
        weight = 1 / np.array([(y == g).sum() for g in y])  # each language counts alike
        target = np.where(y[:, None] == np.array(languages), 1.0, -1.0)
        w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge / len(languages) * np.eye(phi.shape[1]), phi.T @ (target * weight[:, None]))
        return cls(languages, marks, np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """One against the rest, as shares that sum to 1."""
        k = features(texts) @ self.landmarks.T
        s = 4 * (k @ self.weights[:-1] + self.weights[-1])
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, each: int = 300, longest: int = 200_000) -> Model | None:
    """Fit on at most `each` labelled texts of each language that are not held out: those whose ids hash lowest, of
    texts of at most `longest` characters. These bounds, on rows and on bytes, are the only sample; they are there
    because a kernel regression needs few texts. Texts count whole. None if nothing is labelled.

    Rows without an id, a text or a letter teach nothing; of rows that agree in id and text one counts. One pass picks
    the rows of all languages (each task keeps no more than `each` of a language), one fetches their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    by = ["doc_id", "row"]
    order = lambda *cols: Window.partitionBy("lang", *cols).orderBy(F.xxhash64("doc_id"), *by)
    keys = rows.select("doc_id", F.xxhash64("text").alias("row"), "lang").withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(8)))
    # The first of a language are among the first of its parts, so no task reads more than these of all tasks' rows.
    for cols in (["salt"], []):
        keys = keys.withColumn("place", F.row_number().over(order(*cols))).where(F.col("place") <= each)
    keys = keys.groupBy("doc_id", "row").agg(F.max("lang").alias("lang"), F.min("place").alias("place")).collect()
    if not keys:
        return None
    known = docs.sparkSession.createDataFrame([(r.doc_id, r.row) for r in keys], "doc_id long, row long")
    texts = {(r.doc_id, r.row): r.text for r in S.sampled(rows.select("doc_id", "text"), known)}
    chosen = [(texts[r.doc_id, r.row], r.lang) for r in sorted(keys, key=lambda r: (r.lang, r.place, r.doc_id, r.row)) if LETTER.search(texts[r.doc_id, r.row])]
    return Model.fit([t for t, _ in chosen], [g for _, g in chosen]) if len(chosen) > 1 else None


def predicted(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with two more columns, a language and a score (0 to 1): `und` with score 0 where the text is null
    or has no letter, or nothing was learned. Only the text is looked at; nothing is shuffled, and a row comes out for
    each row. Names that a column has already raise ValueError.
    """
    if taken := set(names).intersection(docs.columns):
        raise ValueError(f"there are columns {sorted(taken)} already: name the new ones otherwise")
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = b.column(text).to_pylist()
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
        for k in range(0, len(some), 64):
            s = model.scores([texts[i] for i in some[k : k + 64]])
            for i, row in zip(some[k : k + 64], s):
                langs[i], scores[i] = model.languages[int(row.argmax())], float(row.max())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=out.names)

    return S.map_arrow(docs, run, out)


def identified(docs: DataFrame, each: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents (doc_id, text, lang), a row for each row; learns from those that
    are not held out. A null doc_id isn't held out.
    """
    out = predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, each))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
