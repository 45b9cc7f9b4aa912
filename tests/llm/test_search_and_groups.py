"""Operators 11 to 13 against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import prose
from tideline.llm import blas_search, product_quantisation, spelling

# --- ranked search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_ranks(docs, items, top=20):
    """docs: (doc_id, text), items: (item_id, text). Sorted (item_id, rank, doc_id, score)."""
    terms = [TERM.findall(folded(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        wanted = TERM.findall(folded(text))
        scored = []
        for (doc, _), c, t in zip(docs, counts, terms, strict=True):
            score = 0
            for term in wanted:
                if c[term]:
                    m = 100 - 25 + (25 * len(t) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * ((10**9 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scored.append((-score, 2**63 if doc is None else doc))
        out += [(item, k + 1, None if d == 2**63 else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def ranks(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def searched():
    docs = [(k, prose(k % 37, 40 + k % 50)) for k in range(150)]  # many equal scores
    docs += [(None, prose(3, 60)), (None, None), (500, ""), (501, "... !"), (7, "river River RIVER 42 x42 été"), (502, prose(50, 30_000))]
    items = [(1, prose(1, 20)), (2, "river stone Été 42"), (2, "river stone Été 42"), (None, "light"), (3, ""), (4, None), (5, "nowhere"), (6, "the " * 50 + prose(2, 200))]
    return docs, items


@pytest.mark.parametrize("pass_terms", [blas_search.PASS_TERMS, 60])
def test_ranks_equal_brute_force(spark, searched, pass_terms, monkeypatch):
    docs, items = searched
    monkeypatch.setattr(blas_search, "VOCABULARY_TILE", 16)  # several products an item
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score long, item long").repartition(5)
    wanted = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string")
    assert ranks(blas_search.ranked(frame, wanted, pass_terms=pass_terms)) == brute_ranks(docs, items)


def test_products_stay_exact_when_a_sum_would_pass_two_to_the_53rd():
    weight = (2**53 - 1) // blas_search.MOST_IMPACT
    items = [(0, Counter({1: 3, 2: 1, 5: 1})), (1, Counter({2: 2}))]
    tile = blas_search.ItemTile(items, {1: weight, 2: weight - 5, 5: 7})
    assert len(tile.parts) >= 4
    assert all((w.sum(1) * blas_search.MOST_IMPACT < 2**53).all() for _, w in tile.parts)
    doc, term, impact = np.array([0, 0, 1, 1]), np.array([1, 5, 2, 9]), np.array([999_999, 3, 999_983, 77])
    want = [[3 * weight * 999_999 + 21, 0], [(weight - 5) * 999_983, 2 * (weight - 5) * 999_983]]
    assert tile.scores(doc, term, impact, 2).tolist() == want


def test_search_of_empty_tables(spark, searched):
    docs = spark.createDataFrame(searched[0], "doc_id long, text string")
    items = spark.createDataFrame(searched[1], "item_id long, text string")
    assert ranks(blas_search.ranked(docs.limit(0), items)) == []
    assert ranks(blas_search.ranked(docs, items.limit(0))) == []


# --- near-duplicate vectors --------------------------------------------------------------------------------------------


def brute_links(rows, cosine=0.9):
    """rows: (vec_id, vector). Sorted (vec_id, n_links, component_id, kept)."""
    far = 2**63
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good, strict=True)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = defaultdict(lambda: far)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], far if i is None else i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = None if least[find(k)] == far else least[find(k)]
        out.append((i, links[k], c, i == c))
    return sorted(out, key=repr)


def joined(found):
    return sorted((tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def vectors(seed, length=24):
    g = np.random.default_rng(seed)
    rows = [(k, g.normal(size=length)) for k in range(150)]
    centre = g.normal(size=length)
    rows += [(1000 + k, centre + g.normal(size=length) * 0.1) for k in range(60)]  # a family, its members all different
    rows += [(2000 + k, rows[k][1] * (1 + k)) for k in range(10)]  # same direction
    rows += [(3000 + k, rows[5][1]) for k in range(25)]  # equal rows
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * length, [nan] + [1.0] * (length - 1), [None] + [1.0] * (length - 1), [inf] + [1.0] * (length - 1), [1.0, 2.0], [1.0, 2.1], [5.0]]
    rows += [(4000 + k, v) for k, v in enumerate(odd)]
    rows += [(None, rows[7][1]), (None, rows[7][1]), (None, [3.0, -1.0, 2.0]), (8, rows[160][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize(("kind", "block"), [("double", 4096), ("float", 16)])
def test_links_equal_brute_force(spark, kind, block, monkeypatch):
    monkeypatch.setattr(product_quantisation, "BLOCK", block)  # large lists are dealt out in several tiles
    rows = vectors(1)
    if kind == "float":
        rows = [(i, v and [x and float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n long, h string").repartition(4)
    assert joined(product_quantisation.linked(frame)) == brute_links(rows)


def test_recall_near_the_threshold(spark):
    """Pairs just over the threshold in a random direction, among unrelated vectors of the given tables' length."""
    g = np.random.default_rng(3)
    length, n = 64, 1500
    x = g.normal(size=(2 * n, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(n):
        side = x[n + k] - (x[n + k] @ x[k]) * x[k]
        cos = g.uniform(0.901, 0.95)
        x[n + k] = cos * x[k] + math.sqrt(1 - cos * cos) * side / np.linalg.norm(side)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in product_quantisation.linked(frame).collect()}
    cos = x @ x.T
    true = {k: int((cos[k] >= 0.9).sum()) - 1 for k in range(2 * n)}
    assert all(found[k] <= true[k] for k in true)
    assert sum(found.values()) >= 0.99 * sum(true.values())


def test_lookups_bound_distances_from_below():
    g = np.random.default_rng(4)
    x = g.normal(size=(800, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = product_quantisation.Index(20, 0.9, x[:300], 12)
    own, probes, codes, error = index.coded(x)
    for cell in range(12):
        mine = np.flatnonzero(own == cell)
        rest = x - index.centres[cell]
        bound = np.sqrt(np.maximum(index.lookups(rest, codes[mine]), 0)) - error[mine]
        true = np.sqrt(((x[:, None] - x[mine][None]) ** 2).sum(2))
        assert (bound <= true + 1e-3).all()
    # pairs within twice the reach meet in one list at least, whichever looks
    near = np.argwhere(np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)) <= 2 * index.reach)
    assert all(own[a] == own[b] or own[b] in probes[a] or own[a] in probes[b] for a, b in near)


def test_links_of_an_empty_table(spark):
    assert joined(product_quantisation.linked(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []
    only = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert joined(product_quantisation.linked(only)) == [(1, 0, 1, True), (2, 0, 2, True)]


# --- spelling variants -------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = folded(run)
            if doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in vocabulary if v != w and one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return sorted(out)


def spelt(found):
    return sorted(tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect())


def misspelt(seed, n):
    g, letters = random.Random(seed), "abcdeÀéß×"
    base = ["".join(g.choice(letters) for _ in range(g.randint(4, 9))) for _ in range(12)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "ababab", "bababa", "abababa"]
    out = []
    for _ in range(n):
        w = g.choice(base)
        k = g.randrange(len(w) + 1)
        w = g.choice([w, w, w[:k] + g.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + g.choice(letters) + w[k + 1 :]])
        out.append(w.upper() if g.random() < 0.1 else w)
    return g.choice([" ", ", ", "1", "\n"]).join(out)


@pytest.mark.parametrize("most", [spelling.MOST, 7])
def test_variants_equal_brute_force(spark, odd_rows, most):
    docs = [(k, misspelt(k, 300)) for k in range(12)] + [(None, misspelt(50, 300)), (3, misspelt(3, 300))]
    docs += [r[:2] for r in odd_rows] + [(k, "longword" * 5000 + "ab"[k % 2] + " ") for k in range(900, 908)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(3)
    assert spelt(spelling.variants(frame, most)) == brute_variants(docs)


def test_acceptors_are_minimal_and_walk_each_pair_once():
    machine, g = spelling.Acceptors(), random.Random(5)
    short = sorted({"".join(g.choice("abc") for _ in range(5)) for _ in range(90)})
    long = sorted({"".join(g.choice("abc") for _ in range(6)) for _ in range(150)})
    a, b = machine.accepting(short), machine.accepting(long)
    assert machine.size[a] == len(short) and machine.size[b] == len(long)
    assert len({tuple(sorted(x.items())) for x in machine.arcs}) == len(machine.arcs)
    replaced = sorted(tuple(sorted(p)) for p in machine.replaced(a))
    assert replaced == sorted((i, j) for j in range(len(short)) for i in range(j) if one_edit(short[i], short[j]))
    assert sorted(machine.inserted(a, b)) == sorted((i, j) for i, x in enumerate(short) for j, y in enumerate(long) if one_edit(x, y))


def test_variants_of_an_empty_table(spark, empty):
    assert spelt(spelling.variants(empty)) == []
