"""Spelling variants: words of a corpus that are one edit apart, found by composing acceptors with a one-edit transducer.

Two words near each other have one edit between them, and equal code points before and after it. So they share the first half
or the last half of the shorter one's length. Words go to the classes of both halves (once as the shorter and once as the longer
of a pair), those of last halves read backwards. A class is one initial state: the state that the vocabulary's acceptor is in after
the shared half. From there the remaining code points make a minimised acceptor (states with the same continuations are one, words
are numbered by the counts that states carry), and the composition acceptor - one edit - acceptor is walked: both read the same
code points, then one edit (replaced, or inserted where reading on is impossible, so that each pair has one path only), then both
have to accept the same remainder; equal states need no walk, and what two states share is found once a class. Each class sums
near words up before anything moves.

Initial states with over `most` words are split: words go on to the states after their next code point, and pairs whose edit is
just there meet by what is left after it, in classes that an alphabet's size bounds; again, until no state is larger.

Runs of letters are counted over all texts by columns. Null texts have no words; rows without doc_id lose no code point (there is
no key to hash), rows that share one count for themselves. Of near words with equal n the smaller one, by code points, is the
form. An empty table, or one without frequent words, gives an empty result. A very long text costs memory in proportion to its
runs, a very long word in proportion to its length. Other columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import staged

#: What a word is, one run of EVERY by hash loses a code point, and what counts as a word here.
LETTERS, EVERY, SHORTEST, LEAST = r"[A-Za-zÀ-ÿ]", 97, 5, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that an initial state has at most.
MOST = 20_000
#: Kinds of classes: an initial state; words replaced at one place; words inserted at one place.
STATE, REPLACED, INSERTED = 0, 1, 2
_KEY = ["s", "back", "kind", "key", "tail"]
_ROW = [*_KEY, "long", "rest", "word", "n"]


def words(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least SHORTEST code points and LEAST occurrences. A shorter run can't become one."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    hashed = runs.select(lower.alias("run"), F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), lower).cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    found = hashed.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= SHORTEST)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def _classes(vocabulary: DataFrame) -> DataFrame:
    """_ROW: each word in the states of its halves. s: length of a pair's shorter word; long: the word is one longer."""
    word, back = F.col("word"), F.reverse("word")

    def of(s: Column, long: bool) -> Column:
        first = F.floor(s / 2).cast("int")
        halves = [(word, first, False), (back, s - first, True)]
        return F.array(
            *[
                F.struct(
                    s.alias("s"),
                    F.lit(b).alias("back"),
                    F.lit(STATE).alias("kind"),
                    F.substring(text, F.lit(1), n).alias("key"),
                    F.lit("").alias("tail"),
                    F.lit(long).alias("long"),
                    F.substring(text, n + 1, F.char_length(text)).alias("rest"),
                )
                for text, n, b in halves
            ]
        )

    length = F.char_length("word")
    every = F.filter(F.concat(of(length, False), of(length - 1, True)), lambda x: x["s"] >= SHORTEST)
    return vocabulary.select("word", "n", F.explode(every).alias("_c")).select("_c.*", "word", "n").select(_ROW)


def _split(rows: DataFrame, most: int) -> DataFrame:
    """rows with no state of over `most` words."""
    done, rows = None, staged(rows, "spelling-states")
    while True:
        large = rows.groupBy("s", "back", "key").count().filter(F.col("count") > most).drop("count")
        large = staged(large, "large-states")  # at most rows / most of them
        if not large.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, ["s", "back", "key"], "left_anti").select(_ROW)
        done = small if done is None else done.unionByName(small)
        hot = rows.join(large, ["s", "back", "key"], "left_semi").select(_ROW)
        first, after = F.substring("rest", 1, 1), F.substring(F.col("rest"), F.lit(2), F.char_length("rest"))
        some = F.col("rest") != ""
        edits = hot.filter(~F.col("long") & some).withColumns({"kind": F.lit(REPLACED), "tail": after})
        inserts = hot.filter(some | ~F.col("long")).withColumns({"kind": F.lit(INSERTED), "tail": F.when(F.col("long"), after).otherwise(F.col("rest"))})
        done = staged(done.unionByName(edits.select(_ROW)).unionByName(inserts.select(_ROW)), "spelling-done")
        rows = staged(hot.filter(some).withColumns({"key": F.concat("key", first), "rest": after}).select(_ROW), "spelling-states")


class Acceptors:
    """Minimised acceptors over one register of states. A state: its arcs {code point: (state, words before it)}; size: its words."""

    def __init__(self):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        if (found := self._known.get(key)) is None:
            found = self._known[key] = len(self.arcs)
            before, numbered = 0, {}
            for symbol, to in arcs:
                numbered[symbol] = (to, before)
                before += self.size[to]
            self.arcs.append(numbered)
            self.size.append(before if arcs else 1)
        return found

    def accepting(self, texts: list[str]) -> int:
        """The initial state of an acceptor of texts: distinct, sorted, of one length."""
        path, last = [[]], ""
        for text in texts:
            same = 0
            while same < len(last) and last[same] == text[same]:
                same += 1
            while len(path) > same + 1:
                self._close(path, last)
            path += [[] for _ in range(len(text) - same)]
            last = text
        while len(path) > 1:
            self._close(path, last)
        return self._state(path[0])

    def _close(self, path: list[list], text: str) -> None:
        state = self._state(path.pop())
        path[-1].append((text[len(path) - 1], state))

    def shared(self, a: int, b: int) -> list[tuple[int, int]]:
        """Numbers, below a and below b, of the remainders that both accept."""
        if (found := self._shared.get((a, b))) is None:
            found, open_ = [], [(a, b, 0, 0)]
            while open_:
                x, y, i, j = open_.pop()
                if x == y:
                    found += [(i + k, j + k) for k in range(self.size[x])]
                    continue
                there = self.arcs[y]
                for symbol, (to, before) in self.arcs[x].items():
                    if symbol in there:
                        to_y, before_y = there[symbol]
                        open_.append((to, to_y, i + before, j + before_y))
            self._shared[a, b] = found
        return found

    def replaced(self, start: int) -> Iterator[tuple[int, int]]:
        """Numbers of pairs that differ in one code point."""
        open_ = [(start, 0)]
        while open_:
            state, at = open_.pop()
            arcs = list(self.arcs[state].values())
            for k, (a, i) in enumerate(arcs):
                for b, j in arcs[:k]:
                    for x, y in self.shared(a, b):
                        yield at + i + x, at + j + y
                open_.append((a, at + i))

    def inserted(self, short: int, long: int) -> Iterator[tuple[int, int]]:
        """Numbers of pairs of which the second has one code point more. It is inserted where reading on together ends."""
        open_ = [(short, long, 0, 0)]
        while open_:
            a, b, i, j = open_.pop()
            for symbol, (to, before) in self.arcs[b].items():
                if not self.arcs[a]:
                    yield i, j + before
                    continue
                after = self.arcs[to]
                for c, (to_a, before_a) in self.arcs[a].items():
                    if c == symbol:
                        open_.append((to_a, to, i + before_a, j + before))
                    elif c in after:
                        to_b, before_b = after[c]
                        for x, y in self.shared(to_a, to_b):
                            yield i + before_a + x, j + before + before_b + y


def _pairs(kind: int, short: list[tuple], long: list[tuple], tail: str) -> Iterator[tuple[tuple, tuple]]:
    """Near pairs of a class. short, long: its (rest, word, n), sorted by rest."""
    if kind == REPLACED:
        yield from ((x, y) for k, x in enumerate(short) for y in short[:k])
    elif kind == INSERTED:
        yield from ((x, y) for x in short for y in long if y[0][0] != tail[:1])
    else:
        machine = Acceptors()
        first = machine.accepting([x[0] for x in short])
        yield from ((short[i], short[j]) for i, j in machine.replaced(first))
        if long:
            second = machine.accepting([y[0] for y in long])
            yield from ((short[i], long[j]) for i, j in machine.inserted(first, second))


def _near(rows: DataFrame) -> DataFrame:
    """(word, k, best_n, best): near words of each word in each class: how many, and the one of largest n."""

    def of_class(key: tuple, short: list[tuple], long: list[tuple]) -> list[tuple]:
        s, back, kind, _, tail = key
        half, near = s // 2, {}
        for x, y in _pairs(kind, short, long, tail):
            if back and x[1][:half] == y[1][:half]:
                continue  # met in the class of their first half
            for (_, word, _), (_, other, n) in ((x, y), (y, x)):
                k, best = near.get(word, (0, (0, "")))
                near[word] = k + 1, min(best, (-n, other))
        return [(word, k, -best[0], best[1]) for word, (k, best) in near.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members, out = None, ([], []), []
        for pdf in batches:
            for *here, long, rest, word, n in pdf.itertuples(index=False, name=None):
                if (here := tuple(here)) != key:
                    if members[0] and len(members[0]) + len(members[1]) > 1:
                        out += of_class(key, *members)
                    key, members = here, ([], [])
                members[long].append((rest, word, n))
            yield pd.DataFrame(out, columns=["word", "k", "best_n", "best"])
            out = []
        if members[0] and len(members[0]) + len(members[1]) > 1:
            yield pd.DataFrame(of_class(key, *members), columns=["word", "k", "best_n", "best"])

    ordered = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "long", "rest")
    return ordered.mapInPandas(run, "word string, k long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms (word, form). n doubles at least at each step, so there are no circles, and
    reach doubles each round."""
    to = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        to = staged(to.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_w").isNotNull().alias("_on")), "roots")
        if not to.filter("_on").limit(1).count():
            return to.select("word", "root")
        to = to.drop("_on")


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    vocabulary = staged(words(docs.select("doc_id", F.col("text").cast("string").alias("text"))), "vocabulary")
    near = _near(_split(_classes(vocabulary), most))
    of_word = near.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("_b"))
    joined = vocabulary.join(of_word, "word", "left")
    counts = -F.col("_b.m") >= 2 * F.col("n")
    known = joined.select(
        "word", F.when(counts, F.col("_b.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, -F.col("_b.m")).alias("form_n")
    )
    known = staged(known, "variants")
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
