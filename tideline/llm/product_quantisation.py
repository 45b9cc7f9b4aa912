"""Near-duplicate vectors over an inverted index with product-quantised residuals.

Vectors are compared by cosine, as distance between unit vectors. Equal vectors are one class from the start. A class lies in
the list of its nearest coarse centroid; what is left to the centroid (the residual) is cut into subspaces, each written as
the number of its nearest code. In a list, a table of distances from a query's residual to all codes gives the distance to every
member by look-ups (asymmetric: the query itself isn't coded). As each member's own coding error is stored, look-ups bound the
true distance from below, and only pairs that the bound leaves are compared exactly, in double precision.

Probes: two vectors in different lists lie on two sides of the plane between the centroids, and the parts of their difference
on each side of it add up, so that the nearer one is at most half of that difference away. Every vector therefore looks into each
list whose plane is within `reach`. Pairs within 2 * reach of each other are always found; for others up to the distance of the
threshold, a difference in any direction has a deviation of distance / sqrt(length) along the plane's normal, and reach is SPREAD
of these, halved. For vectors of up to SPREAD^2 components reach is half the threshold's distance: then all pairs are found.

The index (centroids and codes) is fitted on a sample of at most SAMPLE classes, by a hash, per length of vectors, and
sqrt(classes) lists, at most MOST_LISTS; every class is put in. A list's members are dealt out in blocks of about BLOCK, each
block is one tile that queries pass through in chunks; a tile sums the links of each class and hands on a spanning forest of its
links, so no pair is written. What remains are components of these forests.

Null, empty and zero vectors, and those with null or non-finite components, link with nothing and keep their own id. Vectors of
different lengths aren't compared; the INDEXED commonest lengths have an index each, any other is one list, where all are compared.
Equal rows link with each other. Rows without vec_id take part; a component's id is its least vec_id, null where none has one.
Rows that share a vec_id are vectors of their own. An empty table gives an empty result. Labels and other columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import NO_ID, components, join_by_count, small, staged

COSINE = 0.9
SAMPLE, SAMPLE_BYTES, MOST_LISTS, INDEXED = 16_384, 1 << 27, 1024, 16
CODES, PART, ROUNDS = 256, 8, 8
SPREAD = 4.0
BLOCK, CHUNK = 4096, 512
#: Pairs compared exactly at a time.
PAIRS = 1 << 15
#: Room for rounding of look-ups, which are single precision.
_SLACK = 1e-3


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres (fewer rows give fewer) by Lloyd's rounds from rows drawn by seed."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), False)]
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Coarse lists and residual codes for vectors of one length. Without a sample: one list, and codes that say nothing."""

    def __init__(self, length: int, cosine: float, sample: np.ndarray | None = None, lists: int = 1):
        self.apart = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.reach = self.apart / 2 * min(1.0, SPREAD / np.sqrt(length))
        self.cuts = [slice(a, min(a + PART, length)) for a in range(0, length, PART)]
        if sample is None:
            self.centres, self.books = np.zeros((1, length)), [np.zeros((1, s.stop - s.start)) for s in self.cuts]
            return
        self.centres = _means(sample, lists, 1)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [_means(rest[:, s], CODES, 2 + k) for k, s in enumerate(self.cuts)]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """List, further lists to probe, codes, and the codes' error, of unit vectors."""
        far = (self.centres**2).sum(1) - 2 * (x @ self.centres.T)  # squared distances but for a constant a row
        own = np.argmin(far, axis=1)
        rows = np.arange(len(x))
        between = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(2), 1e-18))
        gap = (far - far[rows, own][:, None]) / (2 * between[own])
        near = gap <= self.reach
        near[rows, own] = False
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, s], b) for s, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return own, [np.flatnonzero(r) for r in near], codes, np.sqrt(((rest - decoded) ** 2).sum(1))

    def lookups(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances from queries' residuals to coded members, by tables of distances to codes."""
        out = np.zeros((len(rest), len(codes)), np.float32)
        for k, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, s]
            table = ((part**2).sum(1)[:, None] - 2 * (part @ b.T) + (b**2).sum(1)).astype(np.float32)
            out += np.take(table, codes[:, k], axis=1)
        return out


def unit(raw: list[bytes], kind: np.dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Tile:
    """One block of a list's members."""

    def __init__(self, index: Index, cell: int, rows: pa.Table, kind: np.dtype, cosine: float):
        self.index, self.cell, self.kind, self.cosine = index, cell, kind, cosine
        self.node, self.n = (rows.column(c).to_numpy() for c in ("node", "n"))
        self.x = unit(rows.column("raw").to_pylist(), kind)
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(self.n), -1)
        self.limit = ((index.apart + rows.column("error").to_numpy()) ** 2 + _SLACK).astype(np.float32)
        probes = rows.column("probes").to_pylist()
        row = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
        self.probed = np.sort(row * len(index.centres) + np.array([c for p in probes for c in p], np.int64))

    def _linked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) with a cosine of at least the threshold."""
        i, j = np.nonzero(self.index.lookups(x - self.index.centres[self.cell], self.codes) <= self.limit)
        if len(i) > x.shape[0] * len(self.x) // 16:  # a dense tile: one product is cheaper than gathering pairs
            cos = (x @ self.x.T)[i, j]
        else:
            cos = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", x[i[a : a + PAIRS]], self.x[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)])
        keep = cos >= self.cosine
        return i[keep], j[keep]

    def passed(self, queries: pa.Table) -> pa.RecordBatch:
        """(a, b, k): class a has k more links; b, if any, is in a's component."""
        node, n, cell = (queries.column(c).to_numpy() for c in ("node", "n", "own"))
        i, j = self._linked(unit(queries.column("raw").to_pylist(), self.kind))
        own, at = cell[i], j * len(self.index.centres) + cell[i]
        back = np.isin(at, self.probed)  # the member looks into the query's list as well: one of the two tiles counts
        once = np.where(own == self.cell, node[i] < self.node[j], ~back | (own < self.cell))
        i, j = i[once], j[once]
        both = np.concatenate([node, self.node])
        label = _forest(i, j + len(node), len(both))
        links = np.bincount(i, self.n[j], len(both)) + np.bincount(j + len(node), n[i], len(both))
        some = links > 0
        to = np.where(label == np.arange(len(both)), -1, both[label])
        return pa.RecordBatch.from_arrays(
            [pa.array(both[some]), pa.array(to[some], mask=to[some] < 0), pa.array(links[some].astype(np.int64))], ["a", "b", "k"]
        )


def _fitted(classes: DataFrame, kind: np.dtype, cosine: float) -> dict[int, Index]:
    by_length = classes.groupBy("length").count().orderBy(F.col("count").desc(), "length").limit(INDEXED).collect()
    found = {}
    for r in by_length:
        length, n = r["length"], r["count"]
        size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
        drawn = classes.filter((F.col("length") == length) & (F.pmod(F.xxhash64("h", F.lit(7)), F.lit(n)) < size)).select("h", "embedding")
        rows = drawn.orderBy("h").limit(2 * size).collect()
        if rows:
            x = unit([np.asarray(row["embedding"], kind).tobytes() for row in rows], kind)
            found[length] = Index(length, cosine, x, max(1, min(MOST_LISTS, round(n**0.5))))
    return found


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _index_rows(classes: DataFrame, index: dict[int, Index], kind: np.dtype, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trivial: dict[int, Index] = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            values = batch.column("embedding")
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for k in range(0, len(at), 1024):
                    part = pa.array(at[k : k + 1024])
                    flat = pa.compute.list_flatten(values.take(part)).to_numpy(zero_copy_only=False).astype(kind).reshape(len(part), -1)
                    raw = [r.tobytes() for r in flat]
                    mine = index.get(int(length)) or trivial.setdefault(int(length), Index(int(length), cosine))
                    own, probes, codes, error = mine.coded(unit(raw, kind))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("node").take(part),
                            batch.column("n").take(part),
                            batch.column("length").take(part),
                            pa.array(own.astype(np.int32)),
                            pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32())),
                            pa.array([c.tobytes() for c in codes], pa.binary()),
                            pa.array(error),
                            pa.array(raw, pa.binary()),
                        ],
                        ["node", "n", "length", "own", "probes", "codes", "error", "raw"],
                    )

    rows = classes.select("node", "n", "length", "embedding")
    return rows.mapInArrow(run, "node long, n long, length int, own int, probes array<int>, codes binary, error double, raw binary")


def _links(rows: DataFrame, index: dict[int, Index], kind: np.dtype, cosine: float) -> DataFrame:
    """(a, b, k) as Tile.passed, of all lists. rows: the index."""
    sizes = rows.groupBy("length", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("own", "cell")
    sizes = small(staged(sizes, "list-sizes"))
    members = rows.withColumn("cell", F.col("own")).join(sizes, ["length", "cell"])
    members = members.withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "role": F.lit(0)})
    queries = rows.withColumn("cell", F.explode(F.concat("probes", F.array("own")))).join(sizes, ["length", "cell"])
    queries = queries.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "role": F.lit(1)})
    queries = queries.withColumns({"probes": F.lit(None).cast("array<int>"), "codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")})
    columns = ["length", "cell", "block", "role", "node", "n", "own", "probes", "codes", "error", "raw"]
    both = members.select(columns).unionByName(queries.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, tile, waiting, size = None, [], None, [], 0

        def go() -> Iterator[pa.RecordBatch]:
            if waiting and tile is not None:
                yield tile.passed(pa.Table.from_batches(waiting))

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("length", "cell", "block", "role")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                *here, role = marks[:, a]
                if tuple(here) != key:
                    yield from go()
                    key, members, tile, waiting, size = tuple(here), [], None, [], 0
                if role == 0:
                    members.append(batch.slice(a, b - a))
                    continue
                if tile is None and members:
                    length = int(key[0])
                    tile = Tile(index.get(length) or Index(length, cosine), int(key[1]), pa.Table.from_batches(members), kind, cosine)
                for k in range(a, b, CHUNK):
                    part = batch.slice(k, min(CHUNK, b - k))
                    waiting.append(part)
                    size += part.num_rows
                    if size >= CHUNK:
                        yield from go()
                        waiting, size = [], 0
        yield from go()

    tile_key = ["length", "cell", "block"]
    ordered = both.repartition(*tile_key).sortWithinPartitions(*tile_key, "role")
    return ordered.mapInArrow(run, "a long, b long, k long")


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding: an array of floats or doubles)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = np.dtype(np.float32) if isinstance(element, T.FloatType) else np.dtype(np.float64)
    vector = F.col("embedding") if kind == np.float32 else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), vector.alias("embedding"))
    hashes = F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), "embedding").alias("y"))
    rows = rows.withColumn("h", F.when(_usable(F.col("embedding")), hashes))
    classes = rows.filter("h is not null").groupBy("h").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
    )
    classes = staged(classes.withColumns({"node": F.monotonically_increasing_id(), "length": F.size("embedding")}), "vector-classes")
    index = _fitted(classes, kind, cosine)
    found = staged(_links(staged(_index_rows(classes, index, kind, cosine), "vector-index"), index, kind, cosine), "vector-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("k"))
    label = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    labelled = classes.select("node", "h", "least", "n").join(label, "node", "left").join(links, "node", "left")
    labelled = staged(labelled.withColumn("component", F.coalesce("component", "node")), "vector-components")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    of_class = join_by_count(labelled.drop("least"), staged(least, "component-ids"), "component")
    of_class = of_class.select("h", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), "component_id", F.col("n").alias("_n"))
    result = join_by_count(rows.filter("h is not null").select("id", "h"), staged(of_class, "class-links"), "h").drop("h")
    alone = rows.filter("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = result.unionByName(alone).select(real("id").alias("vec_id"), "n_links", real("component_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
