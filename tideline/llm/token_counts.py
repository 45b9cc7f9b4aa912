"""Token counts by heap-and-linked-list byte-pair merging: a count is initial symbols minus merges; no ids come out.

Null and empty texts have 0 tokens and 0 bytes. Rows are independent: repeated rows, nulls in other columns and extra
columns change nothing; an empty table gives an empty result. Long texts cost memory in proportion to their words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe_vocab import Vocabulary, vocabulary
from tideline.llm.common import kept

#: Words whose counts a worker keeps; when full it starts anew, so results never depend on it.
CACHED_WORDS = 1_000_000


def merged_count(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left after merging: the lowest-ranked adjacent pair first, the leftmost of equals."""
    n = len(symbols)
    heap = [(r[0], i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(pair))]
    if not heap:
        return n
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n or (r := ranks.get((symbols[i], symbols[j]))) is None or r[0] != rank:
            continue  # one of the two has merged otherwise meanwhile
        symbols[i], symbols[j] = r[1], -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if r := ranks.get((symbols[i], symbols[k])):
                heapq.heappush(heap, (r[0], i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))):
            heapq.heappush(heap, (r[0], h))
    return left


def word_count(word: str, v: Vocabulary, pieces: dict[str, int]) -> int:
    total = 0
    for p in v.pieces(word):
        n = pieces.get(p)
        if n is None:
            n = pieces[p] = merged_count(v.first_symbols(p), v.ranks)
        total += n
    return total


def count_text(text: str, v: Vocabulary, known: dict[str, int], pieces: dict[str, int]) -> int:
    total = 0
    for part, special in v.split(text):
        if special:
            total += 1
            continue
        words = v.words(part)
        if len(known) > CACHED_WORDS:
            known.clear()
        if len(pieces) > CACHED_WORDS:
            pieces.clear()
        for w in set(words).difference(known):
            known[w] = word_count(w, v, pieces)
        total += sum(map(known.__getitem__, words))
    return total


def token_count(text: str | Column, vocab_path: str) -> Column:
    """Column of token counts; null counts as the empty text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v, known, pieces = kept(f"counts {vocab_path}", lambda: (vocabulary(vocab_path), {}, {}))
        for texts in batches:
            yield pd.Series([count_text(t, v, known, pieces) if t else 0 for t in texts], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(t).cast("long"), "n_tokens": token_count(t, vocab_path)}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
