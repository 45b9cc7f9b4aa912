"""Exact substring deduplication over a De Bruijn graph of words.

Edges are runs of WINDOW words, nodes the runs of WINDOW - 1 words at an edge's beginning and end, so that an edge is known
by the hashes of its two nodes. Only windows that may occur more than once are made edges: every window names its least k-word
hash (of the k-word runs in it); equal windows name the same one, so only windows that name one which occurs at two places
can be repeated. Equal edges are summed to one, whose least coordinate is its source; coordinates number the words of all
documents in their order.

Compaction: edges meet at their nodes. A node with one edge in and one out doesn't branch, and edges that follow each other
there and in their source are one path, which its source coordinate and length stand for. Paths go to the documents that
are their sources. What a document has of edges beside these paths lies on paths that begin elsewhere, earlier: that is
removed. Windows that cover all these words are verified: the SHA-256 of their words has to be that of the words at the
source coordinate of their edge, both read from the texts. So occurrences of an edge are never joined with each other.

Earlier means smaller doc_id, or same document and earlier start. Rows without doc_id come last. Rows that share a
doc_id but not the text are documents of their own, ordered by a hash of their texts. Of rows with equal texts only the
first is compared with others; the further ones (exact repetitions of a row too) are copies, all of whose windows start
earlier. Null texts have no words. Documents shorter than a window lose nothing. An empty table gives an empty result.
Only doc_id and text are read, and in deduplicated() n_chars follows the text; columns of any other name stay as they are.
A very long text costs memory in proportion to its words, for one text at a time.

Hot keys: occurrences of edges, nodes and windows are summed before they move, and everything that is joined is unique in
its key (an edge, a coordinate, a document). Hashes that over a thousandth of all occurrences share are broadcast (at most a
thousand) to pick texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import NO_ID, hot_share, join_by_count, small, staged, text_of
from tideline.llm.words import WORD, grouped, hashed, runs

WINDOW, K = 20, 8
#: Coordinates are given out in slots of 2^SLOT.
SLOT = 16


def _least(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each start of `window` words the least hash of the k-word runs within."""
    m = runs(h, k)
    span, width = window - k + 1, 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    return m


def _near_equal(m: np.ndarray, reach: int) -> np.ndarray:
    """How many of the first i hashes come again at most `reach` places on, for each i."""
    again = np.zeros(len(m), bool)
    for d in range(1, min(reach, len(m) - 1) + 1):
        again[:-d] |= m[:-d] == m[d:]
    return np.concatenate([[0], np.cumsum(again)])


def _starts(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts that stay within their text, and the text of each."""
    counts = np.maximum(np.diff(at) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(at[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(counts.sum()) + first, text


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))


def _named(keyed: DataFrame, window: int, k: int) -> DataFrame:
    """(m, h, rep): the least hashes that a text's windows name; rep: at several places in the text. Texts go by h alone, as
    which of its rows a task meets first says nothing of which is the first of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # equal texts of a task are looked at once
        for pdf in batches:
            rows = []
            for text, h in zip(pdf["text"], pdf["h"], strict=True):
                if h not in seen:
                    seen.add(h)
                    rows.append((text, h))
            for group in grouped(rows, 0):
                words, at = hashed([r[0] for r in group])
                starts, text = _starts(at, window)
                if not len(starts):
                    continue
                m = _least(words, window, k)[starts]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
                heads = np.flatnonzero(new)
                sizes = np.diff(np.append(heads, len(m)))
                # the same hash at two places: further apart than a window reaches, or (as in periodic texts) close by
                near = _near_equal(runs(words, k), window - k)
                a, b = starts[heads], np.minimum(starts[heads] + sizes + window - k, len(near) - 1)
                long = (sizes > window - k + 1) | (near[b] > near[a])
                m, text = m[heads], text[heads]
                order = np.lexsort((m, text))
                m, text, long = m[order], text[order], long[order]
                first = np.ones(len(m), bool)
                first[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
                heads = np.flatnonzero(first)
                rep = np.logical_or.reduceat(long, heads) | (np.diff(np.append(heads, len(m))) > 1)
                of = text[heads]
                hs = np.array([r[1] for r in group], np.int64)
                yield pd.DataFrame({"m": m[heads].view(np.int64), "h": hs[of], "rep": rep})

    return keyed.select("text", "h").mapInPandas(run, "m long, h long, rep boolean")


def _candidates(keyed: DataFrame, window: int, k: int) -> DataFrame:
    """(h, ms): the named hashes of each text that occur at two places in all."""
    named = _named(keyed, window, k)
    counts = named.groupBy("m").agg(F.min("h").alias("_a"), F.max("h").alias("_b"), F.max("rep").alias("_rep"), F.count(F.lit(1)).alias("_n"))
    repeated = staged(counts.filter("_a < _b or _rep").select("m", "_n"), "repeated-runs")
    total = repeated.agg(F.sum("_n")).first()[0] or 0
    hot = repeated.filter(F.col("_n") > hot_share(total)).select("m", F.lit(True).alias("hot"))
    cold = repeated.select(F.col("m").alias("_m")).join(F.broadcast(hot.select(F.col("m").alias("_m"))), "_m", "left_anti")
    marked = named.select("m", "h").join(F.broadcast(hot), "m", "left")
    cold_rows = marked.filter("hot is null").join(cold, F.col("m") == F.col("_m"), "left_semi")
    both = marked.filter("hot").select("m", "h").unionByName(cold_rows.select("m", "h").distinct())  # once, however many tasks have copies
    return both.groupBy("h").agg(F.collect_set("m").alias("ms"))  # as many as the text has runs


def _numbered(documents: DataFrame) -> DataFrame:
    """documents (doc, h, ms, n_chars) with `at`, the coordinate of their first word: coordinates rise with (doc, h), so that
    the smaller one is the earlier place. A document takes whole slots of 2^SLOT coordinates, at least as many coordinates as
    its text has characters, and each slot is one document's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = 0, TaskContext.get().partitionId()
        for pdf in batches:
            after = total + pdf["slots"].cumsum()
            yield pd.DataFrame({"doc": pdf["doc"], "h": pdf["h"], "ms": pdf["ms"], "slots": pdf["slots"], "_at": after - pdf["slots"], "_part": part})
            total = int(after.iloc[-1]) if len(after) else total

    spark = documents.sparkSession
    sized = documents.withColumn("slots", F.shiftright(F.col("n_chars").cast("long"), SLOT) + 1).select("doc", "h", "ms", "slots")
    ranged = sized.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "h").sortWithinPartitions("doc", "h")
    table = staged(ranged.mapInPandas(run, "doc long, h long, ms array<long>, slots long, _at long, _part int"), "numbered")
    starts, total = [], 0
    for part, n in sorted(table.groupBy("_part").agg(F.sum("slots")).collect()):  # a row a partition
        starts.append((part, total))
        total += n
    before = spark.createDataFrame(starts, "_part int, _before long")
    return table.join(F.broadcast(before), "_part").select("doc", "h", "ms", "slots", F.shiftleft(F.col("_before") + F.col("_at"), SLOT).alias("at"))


def _owners(numbered: DataFrame) -> DataFrame:
    """(slot, doc, h, at): whose each slot is."""
    first = F.shiftright("at", SLOT)
    return numbered.select(F.explode(F.sequence(first, first + F.col("slots") - 1)).alias("slot"), "doc", "h", "at")


def _stretches(keyed: DataFrame, numbered: DataFrame, window: int, k: int) -> DataFrame:
    """(doc, h, at, g, nodes): stretches of windows in a row whose named hash is one of the document's ms. g: the first one's
    coordinate; nodes: hashes of all runs of window - 1 words, one more than windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["doc"], pdf["text"], pdf["h"], pdf["ms"], pdf["at"], strict=True)
            for group in grouped(rows, 1):
                words, begins = hashed([r[1] for r in group])
                starts, text = _starts(begins, window)
                if not len(starts):
                    continue
                m = _least(words, window, k)[starts].view(np.int64)
                ends = np.searchsorted(text, np.arange(len(group) + 1))
                keep = np.zeros(len(m), bool)
                for i, r in enumerate(group):
                    keep[ends[i] : ends[i + 1]] = np.isin(m[ends[i] : ends[i + 1]], np.asarray(r[3], np.int64))
                starts, text = starts[keep], text[keep]
                new = np.ones(len(starts), bool)
                new[1:] = starts[1:] != starts[:-1] + 1
                heads = np.flatnonzero(new)
                first, sizes, of = starts[heads], np.diff(np.append(heads, len(starts))), text[heads]
                nodes = runs(words, window - 1).view(np.int64)
                docs, hs, ats = (np.array([r[i] for r in group], np.int64)[of] for i in (0, 2, 4))
                pieces = [nodes[a : a + n + 1] for a, n in zip(first, sizes, strict=True)]
                yield pd.DataFrame({"doc": docs, "h": hs, "at": ats, "g": ats + first - begins[of], "nodes": pieces})

    joined = keyed.join(numbered, ["doc", "h"]).select("doc", "text", "h", "ms", "at")
    return joined.mapInPandas(run, "doc long, h long, at long, g long, nodes array<long>")


def graph_edges(stretches: DataFrame) -> DataFrame:
    """(a, b, g, n): each edge by its two nodes, with its source coordinate (the least) and how often it occurs."""
    n = F.size("nodes") - 1
    zipped = F.arrays_zip(F.slice("nodes", 1, n).alias("a"), F.slice("nodes", 2, n).alias("b"))
    each = stretches.select("g", F.posexplode(zipped).alias("_i", "_e")).select("_e.a", "_e.b", (F.col("g") + F.col("_i")).alias("g"))
    return each.groupBy("a", "b").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("n"))


def graph_paths(edges: DataFrame) -> DataFrame:
    """(g, head, tail): the ends of the graph's compacted paths, by the source coordinates of their first and last edges.

    Edges meet at their nodes. A node with one edge in and one out doesn't branch, and where the source of the second follows
    that of the first, they are on one path: then every text that has the one edge has the other, and one source coordinate and
    a length stand for all edges of the path. Degrees are sums, so that a node of very many edges costs no more than these."""
    at_b = edges.select(F.col("b").alias("node"), F.lit(1).alias("into"), "g")
    at_a = edges.select(F.col("a").alias("node"), F.lit(0).alias("into"), "g")
    met = at_b.unionByName(at_a).groupBy("node").agg(
        F.sum("into").alias("_in"), F.count(F.lit(1)).alias("_all"), F.max(F.when(F.col("into") == 1, F.col("g"))).alias("_g"), F.max(F.when(F.col("into") == 0, F.col("g"))).alias("_next")
    )
    inner = met.filter("_in = 1 and _all = 2 and _next = _g + 1")
    joined = inner.select(F.inline(F.array(F.struct(F.col("_g").alias("g"), F.lit(1).alias("_k")), F.struct(F.col("_next").alias("g"), F.lit(2).alias("_k")))))
    marks = edges.select("g", F.lit(0).alias("_k")).unionByName(joined).groupBy("g").agg(F.sum("_k").alias("_k"))
    return marks.filter("_k < 3").select("g", (F.col("_k") < 2).alias("head"), (F.col("_k") % 2 == 0).alias("tail"))


def _occurrences(stretches: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """(doc, h, start, a, b): windows that lie on a path whose source is elsewhere. Of such windows in a row the first, every
    window-th and the last, which cover all their words. A document sees the paths that have their source in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, h, at, pieces, heads, tails in zip(pdf["doc"], pdf["h"], pdf["at"], pdf["_pieces"], pdf["_heads"], pdf["_tails"], strict=True):
                nodes = {p["g"]: np.asarray(p["nodes"], np.int64) for p in pieces}  # a row that occurs twice has its stretches twice
                order = sorted(nodes)
                g = np.concatenate([x + np.arange(len(nodes[x]) - 1) for x in order])
                a, b = np.concatenate([nodes[x][:-1] for x in order]), np.concatenate([nodes[x][1:] for x in order])
                heads, tails = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (heads, tails))
                path = np.searchsorted(heads, g, "right") - 1
                here = np.zeros(len(g), bool)
                on = path >= 0
                here[on] = g[on] <= tails[path[on]]
                later = np.flatnonzero(~here)
                if not len(later):
                    continue
                new = np.ones(len(later), bool)
                new[1:] = g[later[1:]] != g[later[:-1]] + 1
                last = np.append(new[1:], True)
                run_start = np.maximum.accumulate(np.where(new, np.arange(len(later)), 0))
                wanted = later[((np.arange(len(later)) - run_start) % window == 0) | last]
                out.append(pd.DataFrame({"doc": doc, "h": h, "start": (g[wanted] - at).astype(np.int32), "a": a[wanted], "b": b[wanted]}))
            if out:
                yield pd.concat(out)

    key = ["doc", "h", "at"]
    pieces = stretches.groupBy(key).agg(F.collect_list(F.struct("g", "nodes")).alias("_pieces"))  # one document's
    ends = lambda kind: F.sort_array(F.collect_list(F.when(F.col(kind), F.col("g")))).alias(f"_{kind}s")
    sources = paths.groupBy(key).agg(ends("head"), ends("tail"))  # one document's
    return pieces.join(sources, key, "left").mapInPandas(run, "doc long, h long, start int, a long, b long")


def _window_digests(keyed: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(a, b, x, y): of each place (doc, h, start, a, b) the first 16 bytes of the SHA-256 of the window's words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, wanted in zip(pdf["text"], pdf["_w"], strict=True):
                words = WORD.findall(text)
                for w in wanted:
                    digest = hashlib.sha256(" ".join(words[w["start"] : w["start"] + window]).encode("utf-8", "surrogatepass")).digest()
                    out.append((w["a"], w["b"], int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)))
            yield pd.DataFrame(out, columns=["a", "b", "x", "y"])

    per = staged(places.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "a", "b")).alias("_w")), "places")  # one document's
    texts = keyed.join(small(per.select("doc", "h")), ["doc", "h"], "left_semi")
    return texts.join(per, ["doc", "h"]).select("text", "_w").mapInPandas(run, "a long, b long, x long, y long")


def _verified(keyed: DataFrame, firsts: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Windows (doc, h, start, a, b) that cover all repeated words and whose words are those at their edge's source, and the
    sources (a, b, doc, h, start, _n) of their edges; _n: how often these occur."""
    documents = staged(_candidates(keyed, window, k).join(firsts, "h").select("doc", "h", "ms", "n_chars"), "edge-documents")
    numbered = _numbered(documents)
    stretches = staged(_stretches(keyed, numbered, window, k), "stretches")
    edges = staged(graph_edges(stretches), "edges")
    owners = _owners(numbered)
    paths = graph_paths(edges).withColumn("slot", F.shiftright("g", SLOT)).join(owners, "slot")
    found = staged(_occurrences(stretches, paths, window), "occurrences")
    sources = edges.filter("n > 1").join(found.select("a", "b").distinct(), ["a", "b"])
    sources = sources.withColumn("slot", F.shiftright("g", SLOT)).join(owners, "slot")
    sources = staged(sources.select("a", "b", "doc", "h", (F.col("g") - F.col("at")).cast("int").alias("start"), F.col("n").alias("_n")), "sources")
    digests = _window_digests(keyed, found.unionByName(sources.drop("_n")), window)
    other = digests.groupBy("a", "b").agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("least_", F.min), ("most_", F.max))])
    other = staged(other.filter("least_x <> most_x or least_y <> most_y").select("a", "b"), "other-words")
    return found.join(small(other), ["a", "b"], "left_anti"), sources


def _firsts(keyed: DataFrame) -> DataFrame:
    """(doc, h, n_chars): the first row of each text."""
    digests = keyed.select("doc", "h", F.md5("text").alias("_md5"), F.char_length("text").alias("n_chars"))
    return staged(digests.groupBy("_md5").agg(F.min(F.struct("doc", "h", "n_chars")).alias("_f")).select("_f.*"), "firsts")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc, h, start, end, s_doc, s_h, s_start): verified windows that together cover all words to be removed: words start to
    end of a document are those from s_start on in their source, the first place where they occur."""
    keyed = _keyed(docs)
    found, sources = _verified(keyed, _firsts(keyed), window, k)
    edge = F.struct("a", "b").alias("edge")
    at_source = sources.select(edge, F.col("doc").alias("s_doc"), F.col("h").alias("s_h"), F.col("start").alias("s_start"), "_n")
    spans = join_by_count(found.select(edge, "doc", "h", "start", (F.col("start") + window).alias("end")), at_source, "edge")
    return spans.select("doc", "h", "start", "end", "s_doc", "s_h", "s_start")


def _kept(text, spans, copy, window: int, with_text: bool):
    """struct of n_words, n_removed and the kept words (as a digest, or as text)."""

    @F.pandas_udf("struct<n_words: long, n_removed: long, kept: string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans, copies in batches:
            rows = []
            for t, spans, copied in zip(texts, all_spans, copies, strict=True):
                words = WORD.findall(t)
                n = len(words)
                if copied and n >= window:
                    words = []
                elif not copied and spans is not None and len(spans):
                    out, at = [], 0
                    for a, b in sorted((s["start"], s["end"]) for s in spans):
                        if a > at:
                            out += words[at:a]
                        at = max(at, b)
                    words = out + words[at:]
                kept = " ".join(words)
                rows.append((n, n - len(words), kept if with_text else hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return run(text, spans, copy)


def _judged(docs: DataFrame, window: int, k: int, with_text: bool) -> DataFrame:
    """docs' rows as _row with _k: n_words, n_removed, kept."""
    keyed = _keyed(docs)
    firsts = _firsts(keyed)
    found, _ = _verified(keyed, firsts, window, k)
    spans = found.groupBy("doc", "h").agg(F.collect_list(F.struct("start", (F.col("start") + window).alias("end"))).alias("_spans"))  # one document's
    spans = staged(spans, "spans")
    known = firsts.select("doc", "h").join(spans, ["doc", "h"], "left").withColumn("_first", F.lit(True))
    rows = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_of()).alias("h")
    )
    joined = rows.join(known, ["doc", "h"], "left")
    again = F.row_number().over(Window.partitionBy("doc", "h").orderBy("doc")) > 1
    joined = joined.withColumn("_copy", F.col("_first").isNull() | again)
    return joined.select("_row", _kept(F.coalesce(F.col("_row.text"), F.lit("")), F.col("_spans"), F.col("_copy"), window, with_text).alias("_k"))


def deduplicated_digests(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text)."""
    return _judged(docs.select("doc_id", "text"), window, k, False).select(
        "_row.doc_id", "_k.n_words", "_k.n_removed", F.col("_k.kept").alias("kept_sha256")
    )


def deduplicated(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs without their repeated words, with docs' columns; texts that lose nothing stay as they are, n_chars follows
    the text, and documents that lose all their words go."""
    out = _judged(docs, window, k, True).filter((F.col("_k.n_removed") == 0) | (F.col("_k.kept") != ""))
    changed = F.col("_k.n_removed") > 0
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.when(changed, F.col("_k.kept")).otherwise(F.col("_row.text")).alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(changed, F.char_length("_k.kept").cast(kind)).otherwise(F.col("_row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"_row.`{c}`"))
    return out.select(*columns)
