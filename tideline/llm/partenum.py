"""N-gram Jaccard join with PartEnum signatures, exact.

A document is the set of its distinct shingles (SHINGLE lower-cased words; all words if it has fewer). Sizes fall into
bands [l, 1.25 l]; sets that reach a Jaccard coefficient of 0.8 lie in the same or in adjacent bands and differ in at
most k = floor(2 r / 9) shingles, r being the upper end of the higher band. So each set signs for its own band and for
the next. Signing for a band: a hash partitions the shingle domain into n1 parts, each into n2; a pair differs by at most
k2 shingles in at least t + 1 of the n1 parts, and there agrees wholly on n2 - k2 of the n2: so every subset of n2 - k2
second-level parts gives a signature, the hash of the shingles in them. Signatures without shingles, which everything
would share, are left out. A set that has them in more than t parts signs once more under the next hash: two similar sets
that agree on nothing else have both such parts in t + 1 places, so both do, and meet there or further on.

Documents that share a signature are compared with the least of them (a star, linear in the group's size): first each
document with the one that leads most of its groups, then those pairs that this left in different components. What stays
open are groups whose other members lie in several components. Members of groups of up to CROWD are compared across
components. A crowded group holds a passage that very many documents share, or copies with so many edits that they fall
just short of 0.8; no signature tells these apart, and pairing them would grow with the square of the group. Sets that link share
a signature for each of t + 1 first-level parts (least_shared), so documents in too few crowded groups are taken out, and groups
that this makes small are compared directly. What documents stay meet by their rarest shingles (counted among the documents of crowded groups): two sets link only if they share
one of those at places in the order by rarity that their sizes allow. Both ways find every link between different
components, so the size of a group decides what is compared, never what is found.

Texts without words have no shingles and link with nothing. Equal texts form a class first, and its least doc_id stands
for it. A missing doc_id counts as the largest; rows that share a doc_id are one node, linked by any of their texts. An
empty table gives an empty result. Only doc_id and text are read, so columns of any other name change nothing. A very
long text costs memory in proportion to its words (about 100 bytes a word), for one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import NO_ID, components, hot_share, join_by_count, small, staged, text_of
from tideline.llm.words import grouped, hashed, mix, runs

SHINGLE = 5
#: Similarity of 0.8 as 100 * shared >= 80 * all.
PERCENT = 80
#: Open groups up to this size are compared directly across components, those of larger ones by their rarest shingles.
CROWD = 16
#: How often documents in too few crowded groups are taken out of these.
THINNED = 2


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    words, at = hashed(texts, lower=True)
    grams = runs(words, SHINGLE)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(runs(words[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


@cache
def band_of(size: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(number, upper end, next band's upper end) of a size's band."""
    low, number = 1, 0
    while True:
        high = low * 100 // percent
        if size <= high:
            return number, high, (high + 1) * 100 // percent
        low, number = high + 1, number + 1


@cache
def parameters(high: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """(n1, n2, k2, t) for a band with this upper end."""
    k = 2 * high * (100 - percent) // (100 + percent)
    if k <= 3:
        return 1, (1, 4, 5, 6)[k], k, 0
    need = k // 2 + 1  # parts of which at least one has at most one difference
    return need + need // 7, 3, 1, need // 7


@cache
def _subsets(n2: int, k2: int) -> np.ndarray:
    """A column for each choice of n2 - k2 second-level parts."""
    chosen = list(combinations(range(n2), n2 - k2))
    out = np.zeros((n2, len(chosen)), np.uint64)
    for i, c in enumerate(chosen):
        out[list(c), i] = 1
    return out


def _places(s: np.ndarray, band: int, again: int, n1: int, n2: int) -> np.ndarray:
    """The second-level part, numbered through all first-level parts, that each of a set's shingles lies in."""
    place = mix(s + np.uint64(band + (again << 20)), 0x9E3779B97F4A7C15)
    return (((place >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)


def signatures(s: np.ndarray) -> np.ndarray:
    """A set's signatures (48 bits each) for its own band and the next one."""
    number, high, next_high = band_of(len(s))
    mixed = mix(s, 0x2545F4914F6CDD1D)
    out = []
    for band, top in ((number, high), (number + 1, next_high)):
        n1, n2, k2, t = parameters(top)
        chosen, again = _subsets(n2, k2), 0
        while True:
            cell = _places(s, band, again, n1, n2)
            count = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2).astype(np.uint64) @ chosen
            total = np.zeros(n1 * n2, np.uint64)
            np.add.at(total, cell, mixed)
            named = np.arange(count.size, dtype=np.uint64).reshape(count.shape) + np.uint64((band << 44) + (again << 36))
            held = count > 0
            out.append(mix((total.reshape(n1, n2) @ chosen)[held] + mix(named, 0xD6E8FEB86659FD93)[held]) >> np.uint64(16))
            if np.count_nonzero(~held.all(1)) <= t:
                break
            again += 1
    return np.concatenate(out)


def least_shared(s: np.ndarray) -> int:
    """How many signatures a set shares at least with any set that links with it: one for each of t + 1 first-level parts, but
    for those where it has a choice of second-level parts without shingles."""
    number, high, next_high = band_of(len(s))
    least = []
    for band, top in ((number, high), (number + 1, next_high)):
        n1, n2, k2, t = parameters(top)
        count = np.bincount(_places(s, band, 0, n1, n2), minlength=n1 * n2).reshape(n1, n2).astype(np.uint64) @ _subsets(n2, k2)
        least.append(max(1, t + 1 - np.count_nonzero(~(count > 0).all(1))))
    return int(min(least))


#: Shingles a cell of a histogram, about.
CELL = 4


def histogram(s: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of 2^i cells, one byte each."""
    m = min(max(16, 1 << (max(1, len(s) // CELL) - 1).bit_length()), 1 << 16)
    return np.minimum(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def may_link(x: bytes, y: bytes, n_x: int, n_y: int) -> bool:
    """False only for sets that differ too much: their histograms differ by no more shingles than they do."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    m = min(len(a), len(b))
    apart = int(np.abs(a.reshape(-1, m).sum(0) - b.reshape(-1, m).sum(0)).sum())
    return apart * (100 + PERCENT) <= (n_x + n_y) * (100 - PERCENT)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().alias("text"))


def _signed(rows: DataFrame) -> DataFrame:
    """(sig, doc) of rows (doc, text, md5). Equal texts of a task sign once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in batches:
            fresh = []
            for doc, text, md5 in zip(pdf["doc"], pdf["text"], pdf["md5"], strict=True):
                key = bytes.fromhex(md5)
                if key not in seen:
                    seen.add(key)
                    fresh.append((doc, text))
            for group in grouped(fresh, 1):
                sets = [(doc, s) for (doc, _), s in zip(group, sets_of([r[1] for r in group]), strict=True) if len(s)]
                if sets:
                    sigs = [signatures(s) for _, s in sets]
                    docs = np.repeat(np.array([doc for doc, _ in sets], np.int64), [len(x) for x in sigs])
                    yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "doc": docs})

    return rows.mapInPandas(run, "sig long, doc long")


def _with_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, s) for the documents in ids (doc)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group in grouped(zip(pdf["doc"], pdf["text"], strict=True), 1):
                yield pd.DataFrame({"doc": [r[0] for r in group], "s": [x.view(np.int64) for x in sets_of([r[1] for r in group])]})

    picked = rows.join(small(ids), "doc", "left_semi")
    return picked.mapInPandas(run, "doc long, s array<long>").filter("size(s) > 0")


def _least_shared(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, _least) for the documents in ids (doc): least_shared of their texts, the lowest where a doc_id has several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group in grouped(zip(pdf["doc"], pdf["text"], strict=True), 1):
                found = [(r[0], least_shared(s)) for r, s in zip(group, sets_of([r[1] for r in group]), strict=True) if len(s)]
                yield pd.DataFrame(found, columns=["doc", "_least"])

    picked = rows.join(small(ids), "doc", "left_semi")
    return picked.mapInPandas(run, "doc long, _least long").groupBy("doc").agg(F.min("_least").alias("_least"))


#: Pairs of a hot document that meet it in one task.
HOT_SLICE = 500


def _met(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, _salt, b, v): for each document a of the pairs its value (b null) and those of its partners, in one task and in
    this order. Each pair sends b's value to a's; a document a that stands in very many pairs is sent to several tasks, and
    its partners are dealt out to those. values: doc, v."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > hot_share(pairs.count())).select("a", (F.col("_n") / HOT_SLICE).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(0))
    centres = small(pairs.select(F.col("a").alias("doc")).distinct().join(F.broadcast(hot.withColumnRenamed("a", "doc")), "doc", "left"))
    centres = values.join(centres, "doc").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts)))
    centres = centres.select(F.col("doc").alias("a"), "_salt", F.lit(None).cast("long").alias("b"), "v")
    partners = pairs.join(F.broadcast(hot), "a", "left").withColumn("_salt", F.pmod(F.xxhash64("b"), parts + 1).cast("int")).drop("_parts")
    partners = values.join(small(partners.withColumnRenamed("b", "doc")), "doc").select("a", "_salt", F.col("doc").alias("b"), "v")
    return centres.unionByName(partners).repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())


def _linking(met: DataFrame, read, link) -> DataFrame:
    """The (a, b) of met for which link(value of a, value of b) holds; read makes values of a list of v."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, own = None, []
        for pdf in batches:
            for group in grouped(zip(pdf["a"], pdf["_salt"], pdf["b"].array, pdf["v"], strict=True), 3):
                found = []
                for (a, salt, b, _), v in zip(group, read([r[3] for r in group]), strict=True):
                    if (a, salt) != centre:
                        centre, own = (a, salt), []
                    if pd.isna(b):
                        own.append(v)
                    elif any(link(o, v) for o in own):
                        found.append((int(a), int(b)))
                yield pd.DataFrame(found, columns=["a", "b"])

    return met.mapInPandas(run, "a long, b long").distinct()


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _near(x: tuple[bytes, int], y: tuple[bytes, int]) -> bool:
    return may_link(x[0], y[0], x[1], y[1])


def _read_histograms(values: list[bytes]) -> list[tuple[bytes, int]]:
    return [(bytes(v[4:]), int.from_bytes(v[:4], "little")) for v in values]


def verified(rows: DataFrame, pairs: DataFrame, histograms: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sets link: those that their histograms (doc, v) leave open meet by their texts."""
    pairs = staged(pairs.select("a", "b"), "pairs")
    open_pairs = staged(_linking(_met(histograms, pairs), _read_histograms, _near), "open-pairs")
    return staged(_linking(_met(rows.select("doc", F.col("text").alias("v")), open_pairs), sets_of, _similar), "links")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (doc, ...) with comp: their component's label, themselves if they have no link."""
    return members.join(labels.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def _crowded_pairs(rows: DataFrame, crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of crowded documents (doc) from different components that may link: with a and b shingles they need
    c = ceil((a + b) * 0.8 / 1.8) in common, so that the first they share in order of rarity is among the first a - c + 1 of
    the one and the first b - c + 1 of the other."""
    sets = staged(_with_sets(rows, crowded), "crowded-sets")
    each = sets.select("doc", F.size("s").alias("_size"), F.explode("s").alias("x"))
    df = staged(each.groupBy("x").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared-shingles")
    ranked = join_by_count(each, df.withColumn("_df", F.col("_n")), "x")
    shared = ranked.groupBy("doc", "_size").agg(F.sort_array(F.collect_list(F.struct("_df", "x"))).alias("_s"))  # one document's
    # those that no other crowded document holds come first
    alone = F.col("_size") - F.size("_s")
    reach = F.greatest(F.col("_size") - F.ceil(F.col("_size") * PERCENT / 100).cast("int") + 1 - alone, F.lit(0))
    first = shared.select("doc", "_size", alone.alias("_alone"), F.posexplode(F.slice("_s", F.lit(1), reach)).alias("_i", "_p"))
    first = staged(_labelled(first.select("doc", "_size", (F.col("_alone") + F.col("_i")).alias("_at"), F.col("_p.x").alias("x")), labels), "rarest")
    # the component that most holders of a shingle are in isn't paired within itself
    held = first.groupBy("x", "comp").agg(F.count(F.lit(1)).alias("_m"))
    held = held.groupBy("x").agg(F.max_by("comp", F.struct("_m", "comp")).alias("_most"), F.count(F.lit(1)).alias("_c"), F.sum("_m").alias("_n"))
    held = join_by_count(first, held.filter("_c > 1").drop("_c"), "x")
    one = held.filter("comp <> _most").select("x", *[F.col(c).alias(f"{c}_1") for c in ("doc", "comp", "_size", "_at")])
    two = held.select("x", "_most", *[F.col(c).alias(f"{c}_2") for c in ("doc", "comp", "_size", "_at")])
    common = F.floor((PERCENT * (F.col("_size_1") + F.col("_size_2")) + (99 + PERCENT)) / (100 + PERCENT))
    near = (F.col("_at_1") <= F.col("_size_1") - common) & (F.col("_at_2") <= F.col("_size_2") - common)
    once = (F.col("comp_2") == F.col("_most")) | (F.col("doc_1") < F.col("doc_2"))
    pairs = one.withColumnRenamed("x", "_x").join(two, (F.col("_x") == F.col("x")) & (F.col("comp_1") != F.col("comp_2")) & near & once)
    return pairs.select(F.least("doc_1", "doc_2").alias("a"), F.greatest("doc_1", "doc_2").alias("b")).distinct()


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (sig, doc) of the groups that lie in several components, with _size, how many members their group has."""
    spread = _labelled(members, labels).groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_a"), F.max("comp").alias("_b"))
    spread = staged(spread.filter("_a <> _b").select("sig", "_n"), "open-groups")
    return staged(join_by_count(members, spread.withColumn("_size", F.col("_n")), "sig"), "open-members")


def _open_pairs(rows: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of members of the same group, in different components; each group's least member, with which all others were
    compared, is left out. Pairs that meet in no small group share crowded ones only, so documents in too few of those go."""
    members = _open_members(groups.filter("doc <> _first").select("sig", "doc").distinct(), labels)
    few, crowd = members.filter(F.col("_size") <= CROWD).select("sig", "doc"), members.filter(F.col("_size") > CROWD).select("sig", "doc")
    if crowd.limit(1).count():
        least = staged(_least_shared(rows, crowd.select("doc").distinct()), "least-shared")
        for _ in range(THINNED):
            enough = crowd.groupBy("doc").agg(F.count(F.lit(1)).alias("_k")).join(least, "doc").filter("_k >= _least").select("doc")
            members = _open_members(staged(crowd.join(small(staged(enough, "enough")), "doc", "left_semi"), "thinned"), labels)
            few = few.unionByName(members.filter(F.col("_size") <= CROWD).select("sig", "doc"))
            crowd = members.filter(F.col("_size") > CROWD).select("sig", "doc")
    few = staged(_labelled(few, labels), "small-groups")
    other = few.select("sig", F.col("doc").alias("b"), F.col("comp").alias("_c"))
    one = few.select(F.col("sig").alias("_sig"), F.col("doc").alias("a"), "comp")
    pairs = one.join(other, (F.col("_sig") == F.col("sig")) & (F.col("a") < F.col("b")) & (F.col("comp") != F.col("_c"))).select("a", "b").distinct()
    crowded = staged(crowd.select("doc").distinct(), "crowded")
    if crowded.limit(1).count():
        pairs = pairs.unionByName(_crowded_pairs(rows, crowded, labels)).distinct()
    return pairs


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text): the smallest doc_id reachable by links."""
    rows = _rows(docs)

    @F.pandas_udf("struct<n_shingles: long, v: binary>")
    def sized(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [s for g in grouped(((t,) for t in texts), 0) for s in sets_of([r[0] for r in g])]
            yield pd.DataFrame({"n_shingles": [len(s) for s in found], "v": [len(s).to_bytes(4, "little") + histogram(s) for s in found]})

    known = staged(rows.select("doc", F.md5("text").alias("md5"), sized("text").alias("_s")).select("doc", "md5", "_s.*"), "sizes")
    histograms = known.select("doc", "v")
    known = known.drop("v")
    classes = known.filter("n_shingles > 0").groupBy("md5").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("_n"))
    classes = staged(classes, "classes")
    copies = join_by_count(known.filter("n_shingles > 0").select("doc", "md5"), classes.filter("_n > 1"), "md5")
    copies = staged(copies.filter("doc <> rep").select("doc", "rep", "md5").distinct(), "copies")  # also ties a doc_id's several texts

    # signatures of each class' first: one shuffle, in which the members of each group meet
    firsts = rows.withColumn("md5", F.md5("text")).join(small(copies.select("doc", "md5")), ["doc", "md5"], "left_anti").select("doc", "text", "md5")
    by_sig = Window.partitionBy("sig").orderBy("doc")
    met = _signed(firsts).withColumn("_first", F.first("doc").over(by_sig)).withColumn("_next", F.lead("doc").over(by_sig))
    groups = staged(met.filter("_first <> doc or _next <> doc").select("sig", "doc", "_first"), "groups")
    stars = groups.filter("doc <> _first").groupBy(F.col("_first").alias("a"), F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("_k"))
    ties = copies.select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    stars = staged(stars.join(ties, ["a", "b"], "left_anti"), "stars")
    # each document with the leader of most of its groups, then all other leaders outside its component
    best = staged(stars.groupBy("b").agg(F.max_by("a", F.struct("_k", -F.col("a"))).alias("a")).select("a", "b"), "best")
    links = verified(rows, best, histograms).unionByName(ties)
    labels = components(links)
    label = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"_of_{c}"))
    across = stars.select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left")
    across = across.filter(F.coalesce("_of_a", "a") != F.coalesce("_of_b", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    links = links.unionByName(verified(rows, across, histograms))
    labels = components(links)
    pairs = staged(_open_pairs(rows, groups, labels).join(stars, ["a", "b"], "left_anti"), "open-pairs")
    if pairs.limit(1).count():
        labels = components(links.unionByName(verified(rows, pairs, histograms)))

    named = classes.join(labels, classes["rep"] == labels["id"], "left").select("md5", F.coalesce("component", "rep").alias("comp"), "_n")
    full = join_by_count(known.filter("n_shingles > 0"), named, "md5").select("doc", "n_shingles", "comp")
    full = full.unionByName(known.filter("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("comp")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return full.select(real("doc").alias("doc_id"), "n_shingles", real("comp").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, with docs' columns: the one with the smallest doc_id stays.
    Rows without doc_id, and those that share a doc_id but not the text, are told apart by their texts and come last; of
    wholly equal ids and texts one row stays."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_of().alias("_t")).withColumn("_h", F.xxhash64("_t"))
    several = keyed.filter("_id is not null").groupBy("_id").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    several = staged(several.filter("_a <> _b").select("_id", F.lit(True).alias("_several")), "repeated-ids")
    stand_in = F.xxhash64("_id", "_t").bitwiseAND(F.lit((1 << 61) - 1))
    key = F.when(F.col("_id").isNull(), stand_in + F.lit(1 << 62)).when(F.col("_several"), stand_in + F.lit(1 << 61)).otherwise(F.col("_id"))
    keyed = keyed.join(small(several), "_id", "left").withColumn("_key", key)
    found = similar_components(keyed.select(F.col("_key").alias("doc_id"), F.col("_t").alias("text")))
    first = staged(found.filter("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct(), "first-of-each")
    kept = keyed.join(first, "_key", "left_semi")
    order = Window.partitionBy("_key").orderBy("_h")
    return kept.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("_row.*")
