"""Language identification with a string kernel.

Kernel: the blended-spectrum presence kernel. Two texts' value is the number of distinct character n-grams (n = 1 to
SPECTRUM, lower-cased, counted by hash among SLOTS slots) that both hold, over the root of the product of their own
numbers. Nyström landmarks: texts of the training sample, equally many a language. One-versus-rest kernel ridge
regression in the landmarks' feature space. A batch of texts is scored by two matrix products: presence by landmarks,
then kernel values by weights.

Training takes only text and lang, at most TRAIN_PER_CLASS documents a language (and TRAIN_ROWS of all), chosen by a hash of
doc_id and text, and of each only a bit for each slot reaches the driver. Scoring takes only the text. Presence is told by
slot, so n-grams that share one of the SLOTS count as one: a kernel of hashed n-grams, the same for all texts.

Null texts and texts without letters are `und` with score 0. Rows without lang don't train. Without any training row
everything is `und`. Repeated rows get equal results; an empty table gives an empty result. lang_pred and score take the place
of columns of those names. A very long text costs about 60 bytes a character, for one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPECTRUM = 3
SLOTS = 1 << 14
TRAIN_PER_CLASS = 300
LANDMARKS_PER_CLASS = 32
#: Rows (SLOTS / 8 bytes each) and landmarks of all languages together: where there are very many, each gets fewer.
TRAIN_ROWS, LANDMARKS = 20_000, 2_048
RIDGE = 1e-2
UNKNOWN = "und"

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TO_SLOT = np.uint64(64 - 14)


def presence(texts: list[str]) -> np.ndarray:
    """texts x SLOTS: 1 where a text holds an n-gram of that slot."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    out = np.zeros(len(texts) * SLOTS, np.float32)
    if not codes:
        return out.reshape(0, SLOTS)
    flat = np.concatenate(codes).astype(np.uint64)
    lengths = np.array([len(c) for c in codes])
    base = np.repeat(np.arange(len(texts), dtype=np.int64) * SLOTS, lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # code points to the end of the text
    gram = np.zeros(len(flat), np.uint64)
    for n in range(1, SPECTRUM + 1):
        size = len(flat) - n + 1
        if size <= 0:
            break
        gram = (gram[:size] + flat[n - 1 :] + np.uint64(1)) * _ODD[n - 1]
        gram ^= gram >> np.uint64(29)
        at = base[:size] + ((gram * _ODD[3]) >> _TO_SLOT).astype(np.int64)
        out[at if n == 1 else at[room[:size] >= n]] = 1
    return out.reshape(len(texts), SLOTS)


#: Texts and characters that are scored at once.
BATCH_TEXTS, BATCH_CHARS = 256, 500_000


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t)
        size += len(t)
        if len(group) >= BATCH_TEXTS or size > BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


class KernelModel:
    def __init__(self, classes: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.classes, self.packed, self.weights = classes, np.packbits(landmarks.astype(bool), axis=1), weights.astype(np.float32)

    def landmarks(self) -> np.ndarray:
        rows = np.unpackbits(self.packed, axis=1).astype(np.float32)
        return (rows / np.sqrt(rows.sum(1, keepdims=True))).T.copy()

    def kernel(self, x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        return (x @ landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def scores(self, texts: list[str], landmarks: np.ndarray) -> np.ndarray:
        """texts x classes, 0 to 1."""
        out = [self.kernel(presence(g), landmarks) @ self.weights for g in batches_of(texts)]
        return np.clip((np.concatenate(out) + 1) / 2, 0, 1) if out else np.zeros((0, len(self.classes)))


def fit(x: np.ndarray, classes: list[str], y: np.ndarray, landmarks_per_class: int = LANDMARKS_PER_CLASS, ridge: float = RIDGE) -> KernelModel:
    """x: presence rows; y: each row's class number."""
    chosen = np.concatenate([np.flatnonzero(y == c)[:landmarks_per_class] for c in range(len(classes))])
    model = KernelModel(classes, x[chosen], np.zeros((len(chosen), len(classes))))
    k = model.kernel(x, model.landmarks()).astype(np.float64)
    kmm = k[chosen]
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # the landmarks' feature space
    phi = k @ root
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    balance = (len(y) / (len(classes) * np.bincount(y, minlength=len(classes))))[y][:, None]
    beta = np.linalg.solve(phi.T @ (balance * phi) + ridge * len(y) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ (balance * target))
    model.weights = (root @ beta).astype(np.float32)
    return model


def train(docs: DataFrame, per_class: int = TRAIN_PER_CLASS) -> KernelModel | None:
    """docs: doc_id, text and lang of the rows that may be learned from."""
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text rlike '\\\\p{L}'")
    sizes = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a language
    if not sizes:
        return None
    classes = [lang for lang, _ in sizes]
    per_class = max(1, min(per_class, TRAIN_ROWS // len(classes)))
    rate = F.create_map(*[x for lang, n in sizes for x in (F.lit(lang), F.lit(min(1.0, 2 * per_class / n)))])
    place = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.xxhash64("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    @F.pandas_udf("binary")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([r.tobytes() for g in batches_of(list(texts)) for r in np.packbits(presence(g).astype(bool), axis=1)])

    # about twice the rows that are used, of which each language's first ones by place come to the driver
    taken = rows.withColumn("_place", place).filter(F.col("_place") < F.try_element_at(rate, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("_place", F.xxhash64("text"))
    chosen = taken.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= per_class)
    sample = chosen.select("lang", "_k", bits("text").alias("_bits")).orderBy("lang", "_k").collect()
    x = np.unpackbits(np.stack([np.frombuffer(bytes(r["_bits"]), np.uint8) for r in sample]), axis=1).astype(np.float32)
    y = np.array([classes.index(r["lang"]) for r in sample])
    present = np.unique(y)  # all, unless the hash took none of a tiny language
    return fit(x, [classes[c] for c in present], np.searchsorted(present, y), max(1, min(LANDMARKS_PER_CLASS, LANDMARKS // len(present))))


def language(text: str | Column, model: KernelModel | None) -> Column:
    """struct(lang_pred, score) of a text column."""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        landmarks = model.landmarks() if model else None
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            if known:
                values = texts.array
                s = model.scores([values[i] for i in known], landmarks)
                best = s.argmax(1)
                lang[known] = np.array(model.classes, object)[best]
                score[known] = s[np.arange(len(best)), best]
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return run(F.col(text) if isinstance(text, str) else text)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def identify(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """docs with lang_pred and score, learned from docs' own lang values in rows that aren't held out."""
    learn = docs if held_out is None else docs.filter(~F.coalesce(held_out, F.lit(False)))
    found = docs.select(F.struct("*").alias("_row"), language("text", train(learn)).alias("_l"))
    return found.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], "_l.*")
