"""Ranked lexical search by dense blocked matrix products.

Every document is scored against every item. Items go in blocks of at most ITEM_TILE rows, whose distinct terms make a
compact vocabulary; documents go in tiles of DOC_TILE rows. A document tile is a dense matrix of impacts over an item block's
vocabulary, an item block one of weights times multiplicities, and their product (float64, BLAS) holds the scores. All factors
are whole numbers, and vocabulary tiles are cut so that no sum of one tile can reach 2^53: products are exact, and tiles are
added up as 64-bit integers. Each task keeps the best `top` documents of each item by (score, smaller doc_id), so equal scores
at the edge of a tile are settled by id, not by order of arrival; the tasks' lists are merged by one window.

A term is a run of letters, digits and all characters from U+0080 on, only A-Z lower-cased. Statistics (documents with terms,
all terms, documents of each term) are counted over all documents. Texts are read once: what stays of a document is its number
of terms and its counts of item terms, in a table.

Null and empty texts have no term: such documents are never ranked, such items get no rows. Items are rows: those that share an
item_id, or are equal, are ranked each for themselves under that id. Rows that share a doc_id are documents of their own; those
without one come after all others of their score. Score 0 isn't ranked. An empty table on either side gives no rows. Other
columns aren't read. A very long text costs memory in proportion to its length, one text at a time.

Items of over PASS_TERMS terms in all go in several passes over the documents, so that what is sent to workers stays bounded."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import NO_ID, staged

TOP, ITEM_TILE, DOC_TILE = 20, 64, 1024
#: Columns of one matrix product at most; a document tile takes 8 * DOC_TILE * VOCABULARY_TILE bytes.
VOCABULARY_TILE = 4096
PASS_TERMS = 500_000
#: Fixed values of the formula: scale of impacts, share of length in percent, saturation, scale of weights.
SCALE, SHARE, SATURATION, WEIGHT = 1_000_000_000, 25, 12, 1000
#: No impact is larger: SCALE * tf div (1000 * tf + ...).
MOST_IMPACT = SCALE // 1000
_EXACT = 2**53

#: Blanks in place of what parts terms, lower-case letters in place of A-Z, all else as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs): each document's number of terms, and its item terms with their counts. numbers: from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.get
        for batch in batches:
            n, offsets, found, counts = [], [0], [], []
            for text in _texts(batch.column("text")):
                words = terms(text)
                n.append(len(words))
                tf = Counter(filter(None, map(known, words)))
                found += tf.keys()
                counts += tf.values()
                offsets.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in ((found, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<long>"), "postings")


class ItemTile:
    """Up to ITEM_TILE items as one matrix a vocabulary tile: columns (term numbers) and weights, a row an item."""

    def __init__(self, items: list[tuple[int, Counter]], weights: dict[int, int]):
        self.items = np.array([i for i, _ in items], np.int64)
        column = {t: k for k, t in enumerate(sorted({t for _, c in items for t in c}))}
        whole = np.zeros((len(items), len(column)), np.int64)
        for row, (_, c) in enumerate(items):
            for t, times in c.items():
                whole[row, column[t]] = weights.get(t, 0) * times
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        numbers, most = np.array(list(column), np.int64), (_EXACT - 1) // MOST_IMPACT
        while whole.any():  # a weight too large for one tile goes on in a further one
            left, ends = np.maximum(whole - most, 0), [0]
            now = whole - left
            total = np.zeros(len(items), np.int64)
            for k in range(len(numbers)):
                total += now[:, k]
                if k - ends[-1] == VOCABULARY_TILE or total.max() > most:
                    ends.append(k)
                    total = now[:, k].copy()
            for a, b in zip(ends, [*ends[1:], len(numbers)], strict=True):
                self.parts.append((numbers[a:b], now[:, a:b].astype(np.float64)))
            whole = left

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """docs x items, whole numbers. doc, term, impact: the tile's postings."""
        out = np.zeros((docs, len(self.items)), np.int64)
        for numbers, weights in self.parts:
            at = np.minimum(np.searchsorted(numbers, term), len(numbers) - 1)
            mine = numbers[at] == term
            dense = np.zeros((docs, len(numbers)))
            dense[doc[mine], at[mine]] = impact[mine]
            out += (dense @ weights.T).astype(np.int64)
        return out


class Best:
    """The best `top` (score, doc) of each item of a tile so far."""

    def __init__(self, tile: ItemTile, top: int):
        self.tile, self.top = tile, top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(len(tile.items), np.int64)  # a score below this can't get in

    def take(self, scores: np.ndarray, docs: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.doc, docs[row])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = place == self.top - 1
        self.least[item[full]] = score[full]


def _best(postings: DataFrame, tiles: list[ItemTile], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc, score): at least the best `top` documents of each item, those of each task."""

    def impacts(n: np.ndarray, tf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        kind = np.int64 if SHARE * int(n.max(initial=0)) * n_docs < 2**63 else object
        m = (100 - SHARE + (n.astype(kind) * SHARE * n_docs) // max(1, n_terms)).astype(np.int64)
        return (SCALE * tf) // (1000 * tf + SATURATION * m[doc])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(t, top) for t in tiles]
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_TILE):
                b = whole.slice(at, DOC_TILE)
                ids, n = b.column("doc").to_numpy(), b.column("n").to_numpy()
                doc = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
                term, tf = (pa.compute.list_flatten(b.column(c)).to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
                impact = impacts(n, tf, doc)
                for x in best:
                    x.take(x.tile.scores(doc, term, impact, len(ids)), ids)
        for x in best:
            yield pa.RecordBatch.from_arrays([pa.array(x.tile.items[x.item]), pa.array(x.doc), pa.array(x.score)], ["item", "doc", "score"])

    return postings.mapInArrow(run, "item long, doc long, score long")


def _one_pass(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    names = sorted({t for _, ts in items for t in ts})
    numbers = {t: k + 1 for k, t in enumerate(names)}
    postings = _postings(docs, numbers)
    count = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = count["docs"], count["terms"] or 0
    # as many rows as this pass's items have distinct terms
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    weights = {r["term"]: math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in df}
    counted = [(i, Counter(numbers[t] for t in ts)) for i, ts in items]
    tiles = [ItemTile(counted[k : k + ITEM_TILE], weights) for k in range(0, len(counted), ITEM_TILE)]
    return staged(_best(postings, tiles, n_docs, n_terms, top), "best")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best `top` documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    # numbers of rows: written once, so that they stay the same
    known = staged(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    passes = max(1, math.ceil((known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 2 / pass_terms))  # a term takes two bytes at least
    found = None
    for p in range(passes):
        rows = known.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).select("item", "text").collect()  # bounded by pass_terms
        texts = [(r["item"], terms((r["text"] or "").encode())) for r in rows]
        if wanted := [x for x in texts if x[1]]:
            best = _one_pass(docs, wanted, top)
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, doc long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(known.select("item", "item_id"), "item").select(
        "item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score"
    )
