"""Operators 3, 5 and 9 against brute force, also where hot keys take their own way."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tideline.llm import common, debruijn, partenum, wu_manber
from tideline.llm.words import hashed, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """rows: (doc_id, text). The expected (doc_id, n_shingles, component_id), sorted."""
    far = 2**63
    ids = [far if i is None else i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    real = lambda x: None if x == far else x
    return sorted(((real(i), len(s), real(find(i)) if s else real(i)) for i, s in zip(ids, sets, strict=True)), key=repr)


def family(seed, size, edits, words=120):
    """Copies of one text, each with its own edited words."""
    base, g = prose(seed, words).split(), random.Random(seed)
    out = []
    for _ in range(size):
        w = base[:]
        for _ in range(g.randint(0, edits)):
            w[g.randrange(len(w))] = f"edit{g.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("crowd", [32, 1])
def test_components_of_families(spark, monkeypatch, crowd):
    """crowd=1: all open groups count as crowded."""
    monkeypatch.setattr(partenum, "CROWD", crowd)
    texts = family(1, 25, 3) + family(2, 12, 6, 60) + family(3, 15, 2, 14) + family(4, 8, 1, 7) + [prose(s, 40) for s in range(10, 40)]
    line = prose(99, 18)
    texts += [f"{line} {prose(s, 6)}" for s in range(50, 70)]  # mostly one common line
    rows = list(enumerate(texts, 1))
    random.Random(7).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in partenum.similar_components(df).collect()), key=repr)
    assert got == brute_components(rows)


def test_components_with_hot_documents(spark, monkeypatch):
    for module in (common, partenum):
        monkeypatch.setattr(module, "hot_share", lambda total: 5)
    monkeypatch.setattr(partenum, "HOT_SLICE", 3)
    monkeypatch.setattr(common, "BROADCAST_IDS", 10)
    texts = family(1, 30, 2) + [prose(5, 30)] * 20
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in partenum.similar_components(df).collect()), key=repr) == brute_components(rows)


def test_components_of_odd_rows(odd, odd_rows, empty):
    got = sorted((tuple(r) for r in partenum.similar_components(odd).collect()), key=repr)
    assert got == brute_components([r[:2] for r in odd_rows])
    assert partenum.similar_components(empty).count() == 0


def test_similar_sets_share_a_signature():
    """Over all sizes, and at both ends of bands: pairs at the threshold."""
    g = np.random.default_rng(1)
    ends = [m for n in range(1, 1200) if partenum.band_of(n) != partenum.band_of(n + 1) for m in (n, n + 1)]
    for size in sorted({*range(1, 40), *ends, 60, 100, 250, 900}):
        for _ in range(30):
            a = np.unique(g.integers(0, 2**63, size, dtype=np.uint64))
            most = 2 * len(a) * 20 // 180
            drop = int(g.integers(0, most + 1)) if most else 0
            add = most - drop
            b = np.unique(np.concatenate([a[drop:], g.integers(0, 2**63, add, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if not shared or 100 * shared < 80 * (len(a) + len(b) - shared):
                continue
            assert np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size, size
            assert partenum.may_link(partenum.histogram(a), partenum.histogram(b), len(a), len(b))


def test_linked_sets_share_enough_signatures():
    g = np.random.default_rng(5)
    for size in (30, 60, 100, 200, 300, 500, 900):
        for _ in range(20):
            base = g.integers(0, 2**64, size, dtype=np.uint64)
            gone = size // 10  # of each: 100 * 9 / 11 of all are shared
            a = np.unique(np.concatenate([base, g.integers(0, 2**64, gone, dtype=np.uint64)]))
            b = np.unique(np.concatenate([base, g.integers(0, 2**64, gone, dtype=np.uint64)]))
            assert partenum._similar(a, b)
            shared = np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size
            assert shared >= max(partenum.least_shared(a), partenum.least_shared(b)) >= 1
    assert partenum.least_shared(g.integers(0, 2**64, 900, dtype=np.uint64)) > 5


def test_documents_in_too_few_crowded_groups_go(spark, monkeypatch):
    """Documents that share a passage share a signature or two of it, those that link share more."""
    monkeypatch.setattr(partenum, "CROWD", 4)
    passage = [f"p{i}" for i in range(160)]
    rows = [(i, " ".join([*passage, *(f"w{i}x{j}" for j in range(640))])) for i in range(60)]
    near = rows[7][1].split()
    for j in (250, 400, 700):
        near[j] = "changed"
    rows.append((60, " ".join(near)))
    looked_at, whole = [], partenum._crowded_pairs

    def seen(docs, crowded, labels):
        looked_at.append(crowded.count())
        return whole(docs, crowded, labels)

    monkeypatch.setattr(partenum, "_crowded_pairs", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in partenum.similar_components(df).collect()), key=repr) == brute_components(rows)
    assert sum(looked_at) < 20  # 37 without


def test_one_of_each(spark, odd):
    rows = [r.asDict() for r in partenum.one_of_each(odd).collect()]
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 14, 15] and sum(r["doc_id"] is None for r in rows) == 2  # texts of null ids differ twice
    assert set(rows[0]) == set(odd.columns)


def brute_removed(rows):
    """rows in order: (text). Word counts, removed counts and kept digests."""
    seen, out = set(), []
    for t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_texts():
    a, b = prose(1, 80), prose(2, 35)
    texts = [a, f"{prose(3, 30)} {b}", f"{b} {prose(4, 25)}", a, a, f"{prose(5, 15)} {a[50:300]} {prose(6, 10)}", "so it goes " * 40, f"x {'so it goes ' * 9}", " ".join(["ab"] * 90), prose(7, 19), prose(7, 20)]
    line = prose(8, 24)
    return texts + [f"{prose(s, 12)}\n{line}\n{prose(s + 500, 7)}" for s in range(20, 60)]


@pytest.mark.parametrize("hot", [1000, 8])
def test_repeated_passages(spark, monkeypatch, hot):
    """hot=8: the common line goes the way of hot keys."""
    monkeypatch.setattr(debruijn, "hot_share", lambda total: hot)
    texts = repeated_texts()
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(4)
    got = [tuple(r)[1:] for r in debruijn.deduplicated_digests(df).orderBy("doc_id").collect()]
    assert got == brute_removed(texts)


def test_copies_in_descending_order(spark):
    """A task that meets a later copy of a text first: the text loses its own repetitions and stays a source."""
    line = prose(9, 30)
    text = f"{line} {prose(10, 40)} {line} {prose(11, 40)}"
    texts = [text, text, f"{prose(12, 15)} {' '.join(text.split()[35:65])} {prose(13, 15)}"]
    df = spark.createDataFrame(list(enumerate(texts, 1))[::-1], "doc_id long, text string").coalesce(1)
    got = [tuple(r)[1:] for r in debruijn.deduplicated_digests(df).orderBy("doc_id").collect()]
    assert got == brute_removed(texts) and [n for _, n, _ in got] == [30, 140, 30]


def test_spans_name_their_source(spark):
    texts = repeated_texts()[:8]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    words = {i: WORD.findall(t) for i, t in enumerate(texts, 1)}
    spans = debruijn.repeated_spans(df).collect()
    assert spans
    for s in spans:
        n = s.end - s.start
        assert words[s.doc][s.start : s.end] == words[s.s_doc][s.s_start : s.s_start + n] and (s.s_doc, s.s_start) < (s.doc, s.start)


def test_paths_of_the_graph(spark):
    """Edges and compacted paths against a graph that is built and walked in plain Python."""
    texts = repeated_texts()
    keyed = debruijn._keyed(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"))
    documents = debruijn._candidates(keyed, 20, 8).join(debruijn._firsts(keyed), "h")
    numbered = debruijn._numbered(documents).cache()
    edges = debruijn.graph_edges(debruijn._stretches(keyed, numbered, 20, 8)).cache()
    words = {i: WORD.findall(t) for i, t in enumerate(texts, 1)}
    ats = sorted((r.at, r.doc) for r in numbered.collect())
    assert [d for _, d in ats] == sorted(d for _, d in ats)  # coordinates rise with the documents

    def window(g):
        at, doc = max(x for x in ats if x[0] <= g)
        return doc, g - at, tuple(words[doc][g - at : g - at + 20])

    counts, place, seen = Counter(), {}, set()
    for i, w in words.items():
        if texts[i - 1] in seen:
            continue  # further copies are not in the graph
        seen.add(texts[i - 1])
        for p in range(len(w) - 19):
            counts[tuple(w[p : p + 20])] += 1
            place.setdefault(tuple(w[p : p + 20]), (i, p))
    rows = edges.collect()
    at = {r.g: window(r.g)[2] for r in rows}
    assert {at[r.g] for r in rows if r.n > 1} == {e for e, n in counts.items() if n > 1} and len(set(at.values())) == len(rows)
    assert all(counts[at[r.g]] == r.n and place[at[r.g]] == window(r.g)[:2] for r in rows)
    into, out = Counter(e[1:] for e in at.values()), Counter(e[:-1] for e in at.values())
    plain = {v for v in into if into[v] == out[v] == 1}
    heads = {g for g, e in at.items() if not (e[:-1] in plain and g - 1 in at and at[g - 1][1:] == e[:-1])}
    tails = {g for g, e in at.items() if not (e[1:] in plain and g + 1 in at and at[g + 1][:-1] == e[1:])}
    ends = debruijn.graph_paths(edges).collect()
    assert {r.g for r in ends if r.head} == heads and {r.g for r in ends if r.tail} == tails
    assert len(heads) == len(tails) < len(at) / 2


def test_other_words_with_equal_hashes_stay(spark, monkeypatch):
    """Verification: windows whose words aren't those of their source are kept."""
    texts = repeated_texts()[:5]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    digests = debruijn._window_digests

    def wrong(keyed, places, window):
        return digests(keyed, places, window).withColumn("x", F.monotonically_increasing_id())

    monkeypatch.setattr(debruijn, "_window_digests", wrong)
    assert [r.n_removed for r in debruijn.deduplicated_digests(df).orderBy("doc_id").collect()][:3] == [0, 0, 0]


def test_no_removal_comes_without_the_paths(spark, monkeypatch):
    """The compacted paths tell a document what it is the source of: without them the first occurrences go as well."""
    texts = repeated_texts()[:3]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    whole = debruijn.graph_paths
    got = [r.n_removed for r in debruijn.deduplicated_digests(df).orderBy("doc_id").collect()]
    monkeypatch.setattr(debruijn, "graph_paths", lambda edges: whole(edges).limit(0))
    without = [r.n_removed for r in debruijn.deduplicated_digests(df).orderBy("doc_id").collect()]
    assert got[1] == 0 and without[1] > 0


def test_a_long_text_takes_several_slots(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "SLOT", 6)
    texts = repeated_texts()
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(3)
    got = [tuple(r)[1:] for r in debruijn.deduplicated_digests(df).orderBy("doc_id").collect()]
    assert got == brute_removed(texts)


def test_repeated_passages_of_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in debruijn.deduplicated_digests(odd).collect()}
    assert {(1, 300, 0), (3, 300, 300), (4, 0, 0), (7, 1, 0), (None, 50, 0), (None, 50, 50), (None, 0, 0), (15, 25, 0), (15, 25, 25)} <= got
    assert debruijn.deduplicated_digests(odd).count() == odd.count() and debruijn.deduplicated_digests(empty).count() == 0
    rows = {r.doc_id: r for r in debruijn.deduplicated(odd).collect() if r.doc_id is not None}
    assert rows[1].text == odd.filter("doc_id = 1").first().text and 3 not in rows and rows[2].n_chars == len(rows[2].text) < 1200
    assert rows[4].text is None and rows[17].text == "one  two\tthree"


def test_word_hashes():
    h, at = hashed(["a b  a", "", "b A", "é a"])
    assert list(at) == [0, 3, 3, 5, 7] and h[0] == h[2] == h[6] and h[1] == h[3] and h[4] != h[0]
    low, _ = hashed(["a b  a", "", "b A"], lower=True)
    assert low[4] == low[0]
    assert len(runs(h, 3)) == 5 and len(runs(h[:2], 3)) == 0


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for i, t in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        m = min(10, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            for a in range(len(w) - m + 1):
                if w[a : a + m] == p[k : k + m]:
                    hit.update(range(a, a + m))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_search(spark, odd, odd_rows, most):
    """most=300: several passes over the documents."""
    p = prose(1, 300).split()
    items = [(1, " ".join(p[20:45])), (2, " ".join(p[20:45])), (10, "WORD"), (9, "one-two THREE"), (3, None), (4, ""), (None, "東京"), (5, " ".join(p[60:70])), (6, prose(77, 30)), (7, "x y x y x y x y x y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, len(r.text or ""), r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in wu_manber.search(odd, bench, most=most).collect()), key=repr)
    want = sorted(((r[0], len(r[1] or ""), *brute_hits(r[1], items)) for r in odd_rows), key=repr)
    assert got == want
    clean = wu_manber.decontaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(not x[3] for x in want)


def test_search_of_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert wu_manber.search(odd, bench).filter("size(spans) > 0").count() == 0
    assert wu_manber.search(empty, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_join_by_count_and_components(spark, monkeypatch):
    monkeypatch.setattr(common, "hot_share", lambda total: 3)
    left = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), ("c", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 9, "A"), ("b", 1, "B")], "k string, _n long, w string")
    assert Counter(r.w for r in common.join_by_count(left, right, "k").collect()) == {"A": 9, "B": 1}
    assert Counter(r.w for r in common.join_by_count(left, right, "k", "left").collect()) == {"A": 9, "B": 1, None: 1}
    g = random.Random(3)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[start] == min(seen)
