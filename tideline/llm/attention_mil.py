"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE code points each, the whole text). A passage is described by the shares of
character classes, of pairs of classes, and by how its words repeat; a layer encodes it, gated attention
(softmax of w . (tanh(V h) * sigmoid(U h))) weighs the encodings, and a logistic unit scores the weighted sum. All
weights are learned together from document labels.

Training takes at most TRAIN_PER_LABEL labelled documents a label, chosen by a hash of doc_id (then by doc_id), with all
their passages; scoring takes every passage of every text, and nothing but the text.

A null text is scored as the empty text, which is one empty passage. Documents with several labels count by their mean.
Without labels of both kinds the score is the share of label 1 among what there is (0.5 without any). Repeated rows get
equal scores; an empty table gives an empty result. Other columns are neither read nor changed. A very long text costs about
100 bytes a character, for one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import released

PASSAGE = 400
TRAIN_PER_LABEL = 1500
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY = 150, 0.02, 1e-4

#: Character classes: lower case, upper case, digit, blank, line end, beyond ASCII, then each ASCII sign.
_CLASS = np.full(129, 5, np.int64)
_CLASS[: 128] = 6 + 32
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else _CLASS[_i]
for _i, _c in enumerate(c for c in map(chr, range(33, 127)) if not c.isalnum()):
    _CLASS[ord(_c)] = 6 + _i
N_CLASS = 39
N_FEATURES = N_CLASS + 49 + 5
#: For pairs: signs are one class.
_COARSE = np.minimum(np.arange(N_CLASS), 6)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and how many each text has (one at least)."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = int(counts.sum())
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, "<u4")
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    which = np.repeat(first, lengths) + (np.arange(len(flat)) - start) // PASSAGE
    kind = _CLASS[np.minimum(flat, 128)]
    size = np.maximum(np.bincount(which, minlength=n), 1)[:, None]
    single = np.bincount(which * N_CLASS + kind, minlength=n * N_CLASS).reshape(n, N_CLASS) / size
    same = which[1:] == which[:-1]
    coarse = _COARSE[kind]
    pair = np.bincount((which[1:] * 49 + coarse[:-1] * 7 + coarse[1:])[same], minlength=n * 49).reshape(n, 49) / size
    # words: runs between white space within a passage, told apart by a sum of powers of their characters
    blank = (kind == 3) | (kind == 4)
    out = np.zeros((n, 5))
    if len(flat):
        begins = ~blank
        begins[1:] &= blank[:-1] | ~same
        at = np.flatnonzero(begins)
        if len(at):
            word_of = np.cumsum(begins)
            letters = np.where(blank, 0, flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            place = (np.arange(len(flat)) - at[np.maximum(word_of - 1, 0)]).astype(np.uint64)
            mixed = letters * (np.uint64(2) * place + np.uint64(1))
            mixed ^= mixed >> np.uint64(31)
            words = np.add.reduceat(mixed * np.uint64(0xC2B2AE3D27D4EB4F), at)
            width = np.add.reduceat((~blank).astype(np.int64), at)
            owner = which[at]
            total = np.bincount(owner, minlength=n)
            order = np.lexsort((words, owner))
            new = np.ones(len(order), bool)
            new[1:] = (owner[order][1:] != owner[order][:-1]) | (words[order][1:] != words[order][:-1])
            distinct = np.bincount(owner[order][new], minlength=n)
            again = np.zeros(len(at), bool)
            again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
            safe = np.maximum(total, 1)
            mean = np.bincount(owner, width, minlength=n) / safe
            out[:, 0] = distinct / safe
            out[:, 1] = np.bincount(owner, again, minlength=n) / safe
            out[:, 2] = mean / 10
            out[:, 3] = np.sqrt(np.maximum(np.bincount(owner, width.astype(float) ** 2, minlength=n) / safe - mean**2, 0)) / 10
    out[:, 4] = np.log1p(np.bincount(which, minlength=n)) / 6
    return np.hstack([np.sqrt(single), np.sqrt(pair), out]).astype(np.float32), counts


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """weights: encoder E, e; gate V, U, w; output c, d. mean, spread: of the training passages."""

    def __init__(self, weights: dict[str, np.ndarray] | None, mean=None, spread=None, constant: float = 0.5):
        self.w, self.mean, self.spread, self.constant = weights, mean, spread, constant

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages of bags of `counts` passages."""
        w = self.w
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        raw = (t * s) @ w["w"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), counts))
        a = raw / np.repeat(np.add.reduceat(raw, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "starts": starts}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.w is None or not texts:
            return np.full(len(texts), self.constant)
        x, counts = features(texts)
        return self.forward((x - self.mean) / self.spread, counts)["p"]


def gradients(model: AttentionModel, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss, by all weights."""
    f = model.forward(x, counts)
    h, t, s, a = f["h"], f["t"], f["s"], f["a"]
    dp = (f["p"] - y) / len(y)
    dz = np.repeat(np.outer(dp, model.w["c"]), counts, axis=0)
    da = (dz * h).sum(1)
    draw = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), counts))
    dt, ds = np.outer(draw, model.w["w"]) * s * (1 - t * t), np.outer(draw, model.w["w"]) * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ model.w["V"].T + ds @ model.w["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ draw, "c": f["z"].T @ dp, "d": np.array([dp.sum()])}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 1) -> AttentionModel:
    """x: passages of bags of `counts` passages; y: 0 or 1 for each bag. Adam over all bags."""
    if not len(y) or y.min() == y.max():
        return AttentionModel(None, constant=float(y.mean()) if len(y) else 0.5)
    g = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0) + 1e-2
    x = (x - mean) / spread
    w = {
        "E": g.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        "e": np.zeros(HIDDEN),
        "V": g.normal(0, 0.3, (HIDDEN, GATE)),
        "U": g.normal(0, 0.3, (HIDDEN, GATE)),
        "w": g.normal(0, 0.3, GATE),
        "c": g.normal(0, 0.3, HIDDEN),
        "d": np.zeros(1),
    }
    model = AttentionModel(w, mean, spread)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for step in range(1, STEPS + 1):
        grad = gradients(model, x, counts, y)
        for k in w:
            grad[k] += DECAY * w[k]
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.001 * (grad[k] ** 2 - v[k])
            w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> AttentionModel:
    """docs: doc_id, text. labels: doc_id and quality of the rows that may be learned from."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("_y")
    )
    sizes = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return AttentionModel(None)
    share = sizes.get(1, 0) / sum(sizes.values())
    place = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    marks = marks.withColumn("_place", place)
    # at most per_label rows of each label, so the chosen ids may go to every task
    chosen = [marks.filter(F.col("_y") == y).orderBy("_place", "doc_id").limit(per_label) for y in sizes]
    sample = chosen[0]
    for c in chosen[1:]:
        sample = sample.unionByName(c)

    @F.pandas_udf("binary")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        released()
        for texts in batches:
            out = []
            for t in texts:
                out.append(features([t or ""])[0].astype("<f4").tobytes())
            yield pd.Series(out)

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "_y", described("text").alias("_x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(bytes(r["_x"]), "<f4").reshape(-1, N_FEATURES) for r in rows]
    if not bags:
        return AttentionModel(None, constant=share)
    y = np.array([r["_y"] for r in rows], float)
    model = fit(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), y)
    if model.w is not None and 0 < share < 1:  # the sample may hold label 0 more often than the labels do: shift back
        model.w["d"] = model.w["d"] + np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return model


#: Characters of the texts that are scored at once.
BATCH_CHARS = 100_000


def scored(batches: Iterator[pd.Series], model: AttentionModel) -> Iterator[pd.Series]:
    """Scores of texts, in a worker."""
    released()
    for texts in batches:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size > BATCH_CHARS:
                out.append(model.scores(group))
                group, size = [], 0
        out.append(model.scores(group))
        yield pd.Series(np.concatenate(out))


def quality(text: str | Column, model: AttentionModel) -> Column:
    """Score, 0 to 1, of a text column."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scored(batches, model)

    return run(F.col(text) if isinstance(text, str) else text)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least `threshold`, with docs' columns."""
    model = train(docs, labels)
    return docs.select(F.struct("*").alias("_row"), quality("text", model).alias("_score")).filter(F.col("_score") >= threshold).select("_row.*")
