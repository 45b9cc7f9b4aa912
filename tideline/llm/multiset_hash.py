"""Homomorphic multiset hashes of documents.

A document is the multiset of its paragraphs: its lines, but for empty ones. Each paragraph is hashed whole to LANES numbers
below 2^32, and each of its runs of words to SIGNS of +1 or -1. A fingerprint is the sum over all paragraphs, lanes modulo
2^32 and signs too (as signed numbers). It doesn't depend on order; adding or subtracting a paragraph's vector inserts or deletes it.
The lanes tell multisets of paragraphs apart; the sums of signs keep likeness: their cosine estimates how many runs two
texts share, also for texts of one paragraph.

Runs are of RUN words. They don't cross full stops, and parts longer than LONG characters are cut at words picked by their
hash, so that an edit moves no other cut.

Null is the empty text: no paragraphs, a fingerprint of zeros. Rows without doc_id come first in order, rows that share
one are ordered by a hash of their texts; exact repetitions follow each other. The document after the last is the first
(a single document follows itself). An empty table gives an empty result. Only doc_id and text are read, so columns of any
other name change nothing. A very long text costs about 100 bytes a word, for one text at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import text_of

LANES, SIGNS = 64, 128
LONG, RUN = 300, 4
ALIKE = 0.999
_BREAK = re.compile(r"(?:\.\s)+")
_WORD = re.compile(r"\S+\s*")
_RUN = re.compile(rf"\S+(?:\s+\S+){{0,{RUN - 1}}}")


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def runs(paragraph: str) -> list[str]:
    """A paragraph's runs of words."""
    out: list[str] = []
    for p in _BREAK.split(paragraph):
        if len(p) <= LONG:
            out += _RUN.findall(p)
            continue
        at = start = 0
        for w in _WORD.findall(p):
            at += len(w)
            if zlib.crc32(w.encode("utf-8", "surrogatepass")) % 12 == 0:
                out += _RUN.findall(p[start:at])
                start = at
        out += _RUN.findall(p[start:])
    return out


def lane_sums(units: list[str]) -> np.ndarray:
    """Row i is the sum of the first i paragraphs' lanes."""
    out = np.zeros((len(units) + 1, LANES), "<u4")
    raw = b"".join([hashlib.shake_128(u.encode("utf-8", "surrogatepass")).digest(4 * LANES) for u in units])
    np.cumsum(np.frombuffer(raw, "<u4").reshape(-1, LANES), axis=0, dtype="<u4", out=out[1:])
    return out


def sign_sums(units: list[str]) -> np.ndarray:
    """Row i is the sum of the first i runs' signs."""
    out = np.zeros((len(units) + 1, SIGNS), "<i4")
    raw = b"".join([hashlib.blake2b(u.encode("utf-8", "surrogatepass"), digest_size=SIGNS // 8).digest() for u in units])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, SIGNS // 8), axis=1)
    np.cumsum(bits.astype("<i4") * np.int32(2) - np.int32(1), axis=0, dtype="<i4", out=out[1:])
    return out


class Fingerprint:
    def __init__(self, lanes: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.lanes = np.zeros(LANES, "<u4") if lanes is None else lanes
        self.signs = np.zeros(SIGNS, "<i4") if signs is None else signs

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls().insert(paragraphs(text or ""))

    def insert(self, units: Iterable[str]) -> Fingerprint:
        """With these paragraphs."""
        units = list(units)
        return Fingerprint(self.lanes + lane_sums(units)[-1], self.signs + sign_sums([r for u in units for r in runs(u)])[-1])

    def delete(self, units: Iterable[str]) -> Fingerprint:
        """Without these paragraphs."""
        units = list(units)
        return Fingerprint(self.lanes - lane_sums(units)[-1], self.signs - sign_sums([r for u in units for r in runs(u)])[-1])

    def __str__(self) -> str:
        return base64.b64encode(self.lanes.tobytes() + self.signs.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 4 * LANES], "<u4").copy(), np.frombuffer(raw[4 * LANES :], "<i4").copy())

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1; 1 only for equal multisets, ALIKE at most for others that share all their runs."""
        if np.array_equal(self.lanes, other.lanes):
            return 1.0
        a, b = self.signs.astype(float), other.signs.astype(float)
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(ALIKE, max(0.0, a @ b / size))) if size else 0.0


def fingerprint(text: str = "text"):
    """Fingerprint column of a text column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([str(Fingerprint.of(t)) for t in texts], dtype=object)

    return run(F.col(text))


def edited_text(text: str, after: str) -> str:
    """The last quarter of text's code points gives way to as many (or all) of the following document's first ones."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Code points of the texts that are hashed at once.
BATCH_CHARS = 500_000


class _Sums:
    """Units of many texts, in one list whose running sums give any stretch of it."""

    def __init__(self, sums):
        self.units: list[str] = []
        self.sums = sums
        self.at: list[tuple[int, int, int, int]] = []

    def add(self, own: list[str], other: list[str]) -> None:
        """A text's units and its edited text's: what they begin with alike is added once."""
        same = next((k for k, (a, b) in enumerate(zip(own, other, strict=False)) if a != b), min(len(own), len(other)))
        start = len(self.units)
        self.units += own + other[same:]
        self.at.append((start, start + same, start + len(own), len(self.units)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's sum, and its edited text's: the tail deleted, the other one inserted."""
        total = self.sums(self.units)
        for a, same, b, c in self.at:
            own = total[b] - total[a]
            yield own, own - (total[b] - total[same]) + (total[c] - total[b])


def _compare(rows: list[tuple]) -> pd.DataFrame:
    """rows: (bucket, ahead, doc_id, text) in order. A result for each row that has its successor behind it."""
    lanes, signs, edits = _Sums(lane_sums), _Sums(sign_sums), []
    for i, r in enumerate(rows):
        follows = i + 1 < len(rows) and not r[1] and rows[i + 1][0] == r[0]
        edits.append(edited_text(r[3], rows[i + 1][3]) if follows else None)
        own = paragraphs(r[3])
        new = own if edits[i] is None else paragraphs(edits[i])
        lanes.add(own, new)
        of = {p: runs(p) for p in {*own, *new}}
        signs.add([x for p in own for x in of[p]], [x for p in new for x in of[p]])
    prints = [(Fingerprint(a, c), Fingerprint(b, d)) for (a, b), (c, d) in zip(lanes.pairs(), signs.pairs(), strict=True)]
    out = []
    for i, edited in enumerate(edits):
        if edited is not None:
            own, other = prints[i]
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((rows[i][2], len(rows[i][3]), digest, str(own), str(other), own.likeness(other), own.likeness(prints[i + 1][0])))
    pdf = pd.DataFrame(out, columns=COLUMNS)
    pdf["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in pdf["doc_id"]], "Int64")
    return pdf


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    size = 0
    for pdf in batches:
        for r in zip(pdf["_bucket"], pdf["_ahead"], pdf["doc_id"].array, pdf["text"], strict=True):
            held.append(r)
            size += len(r[3])
            if size > BATCH_CHARS and len(held) > 1:
                yield _compare(held)
                held, size = held[-1:], len(r[3])
    if held:
        yield _compare(held)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of doc_id, text rows, of their edited texts, and the likeness to those and to the next document's.

    Documents are dealt out by ranges of doc_id; each range also gets the first document of the following one, so texts
    move once. The bounds and first documents are as many as there are ranges."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("_h", F.xxhash64("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = np.array(sorted(set(bounds)), np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="right")
        return pd.Series(found.astype(np.int32))

    placed = rows.withColumn("_bucket", bucket(F.coalesce("doc_id", F.lit(-(2**63)))))
    heads = placed.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_h")).alias("_first")).orderBy("_bucket").collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    wanted = [(heads[(k + 1) % len(heads)]["_first"]["doc_id"], heads[(k + 1) % len(heads)]["_first"]["_h"], h["_bucket"]) for k, h in enumerate(heads)]
    wanted = spark.createDataFrame(wanted, "_id long, _hash long, _bucket int")
    ahead = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))).dropDuplicates(["_bucket"])
    columns = ["_bucket", "_ahead", "doc_id", "text", "_h"]
    both = placed.withColumn("_ahead", F.lit(0)).select(columns).unionByName(ahead.withColumn("_ahead", F.lit(1)).select(columns))
    dealt = both.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_ahead", F.col("doc_id").asc_nulls_first(), "_h", "text")
    return dealt.select("_bucket", "_ahead", "doc_id", "text").mapInPandas(_run, SCHEMA)
