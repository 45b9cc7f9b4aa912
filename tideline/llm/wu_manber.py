"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of a-z (A-Z lower-cased), 0-9 and characters outside ASCII. A benchmark item gives a test string for each
window of ten consecutive words, or one of all its words if it has fewer. Test strings of equal length are searched
together: the shift table says by how many words the search window may move for the block of two words at its end; where
it may not move, the hash of the block picks a bucket of test strings, and each is compared word by word.

The test strings go to the tasks in blocks of at most MAX_PATTERN_WORDS words; a larger benchmark takes a further pass
over the documents for each block, and what the passes find is joined, so nothing is dropped at any size.

Null texts have no words, as do items without text; items without item_id are searched for but not listed. Equal items
are all listed. Repeated rows are judged each for itself; an empty table on either side gives no hits. search()'s n_words,
spans and item_ids take the place of columns of those names. A very long text costs memory in proportion to its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import staged

#: Words in the test strings that one pass carries: the size bound of what every task gets.
MAX_PATTERN_WORDS = 4_000_000
WINDOW = 10

#: Fixed value: the words of a text after A-Z are lower-cased.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower() if text.isascii() else text.translate(LOWER))


class Matcher:
    """Test strings (tuples of words) of one length."""

    def __init__(self, patterns: dict[tuple[str, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.patterns = patterns
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict[int, list[tuple[str, ...]]] = {}
        for p in patterns:
            for at in range(length - self.block + 1):
                block, shift = self._block(p, at + self.block - 1), length - self.block - at
                if shift < self.shift.get(block, self.most):
                    self.shift[block] = shift
            self.buckets.setdefault(hash(self._block(p, length - 1)), []).append(p)

    def _block(self, words, end: int):
        return (words[end - 1], words[end]) if self.block == 2 else words[end]

    def search(self, words: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, test string) of all occurrences."""
        n, m, most, shift = len(words), self.length, self.most, self.shift.get
        i = m - 1
        if self.block == 1:
            for i, w in enumerate(words):
                if shift(w) == 0:
                    yield i, (w,)
            return
        while i < n:
            block = (words[i - 1], words[i])
            move = shift(block, most)
            if move:
                i += move
                continue
            start = i - m + 1
            for p in self.buckets.get(hash(block), ()):
                if all(map(str.__eq__, p, words[start : i + 1])):
                    yield start, p
            i += 1


class Searcher:
    """items: (number of the item, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for item, words in items:
            m = min(window, len(words))
            for at in range(len(words) - m + 1) if m else ():
                owners = by_length.setdefault(m, {}).setdefault(tuple(words[at : at + m]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.matchers = [Matcher(p, m) for m, p in sorted(by_length.items())]

    def find(self, text: str) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, the covered word ranges (start, end) in order and apart, the items found."""
        words = words_of(text)
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for m in self.matchers:
            for start, p in m.search(words):
                spans.append((start, start + m.length))
                items.update(m.patterns[p])
        return len(words), joined(spans), sorted(items)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, window: int, most: int) -> list[DataFrame]:
    """The benchmark's distinct texts, each with the ids of its items, in parts of at most `most` test-string words (or of one
    text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("_id"), F.col("text").alias("_text")).filter("_text is not null")
    sized = items.groupBy("_text").agg(F.collect_set("_id").alias("_ids"))
    total = sized.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, -(-total * window // (2 * most)))  # a word has two bytes at least, with what parts it from the next
    return [sized] if n == 1 else [sized.filter(F.pmod(F.xxhash64("_text"), F.lit(n)) == k) for k in range(n)]


def _finder(sent, window: int):
    @F.pandas_udf("struct<n: long, spans: array<struct<start: int, end: int>>, items: array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, items = sent.value
        searcher = Searcher(list(enumerate(items)), window)
        for texts in batches:
            rows = []
            for t in texts:
                n, spans, found = searcher.find(t) if t else (0, [], [])
                rows.append((n, [{"start": a, "end": b} for a, b in spans], sorted({x for i in found for x in names[i]})))
            yield pd.DataFrame(rows, columns=["n", "spans", "items"])

    return run


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MAX_PATTERN_WORDS) -> DataFrame:
    """docs with n_words, spans (word ranges hit) and item_ids (as strings, sorted)."""
    spark = docs.sparkSession
    parts = _blocks(benchmark, window, most)
    out = docs.drop("n_words", "spans", "item_ids")
    for k, part in enumerate(parts):
        rows = part.collect()  # bounded by `most`
        sent = spark.sparkContext.broadcast(([r["_ids"] for r in rows], [words_of(r["_text"]) for r in rows]))
        out = out.withColumn(f"_found{k}", _finder(sent, window)(F.col("text")))
        if len(parts) > 1:  # a pass is over before the next one's test strings go out
            out = staged(out, f"pass-{k}")
            sent.destroy()
    found = [f"_found{k}" for k in range(len(parts))]
    if len(found) == 1:
        out = out.withColumns({"n_words": F.col("_found0.n"), "spans": F.col("_found0.spans"), "item_ids": F.col("_found0.items")})
    else:
        spans = F.array_sort(F.flatten(F.array(*[F.col(f"{f}.spans") for f in found])))
        merged = F.aggregate(
            spans,
            F.array().cast("array<struct<start: int, end: int>>"),
            lambda acc, s: F.when(
                (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
                ),
            ).otherwise(F.concat(acc, F.array(s))),
        )
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{f}.items") for f in found]))))
        out = out.withColumns({"n_words": F.col("_found0.n"), "spans": merged, "item_ids": items})
    return out.drop(*found)


def hits(spans: str = "spans"):
    """Words in spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no test string occurs, with docs' columns."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text"))
    return search(rows, benchmark, window).filter(F.size("spans") == 0).select("_row.*")
