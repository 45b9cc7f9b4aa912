"""BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct new pieces of a batch, sorted, are the paths of a trie in depth-first order: a piece keeps the nodes it shares
with the one before. A node's state is the last token of the encoding of its prefix. A token t that ends a prefix is its
last token if the rest of the prefix ends in a token u for which u, t is what merging their joint symbols gives; adjacent
pairs that merging leaves alone make up the whole encoding, and just one t qualifies. So the longest t is tried first, and a
state is worked out only when one asks for it, once for all words that share the prefix.

Null and empty texts have no ids and decode to the empty text. Rows are independent: repeated rows, nulls in other
columns and extra columns change nothing, but encode()'s ids and decoded take the place of columns of those names; an
empty table gives an empty result. Long texts cost memory in proportion to their words, long words to their letters.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe_vocab import Vocabulary, vocabulary
from tideline.llm.common import kept, released

#: Encodings in a generation of words, and of pieces: a worker keeps two, and a full one drops the one before. Token pairs
#: whose checks it keeps; when full it starts anew. About 70 MB a worker in all.
CACHED_WORDS, CACHED_PIECES, CACHED_PAIRS = 100_000, 30_000, 150_000
#: Depths from one state that is asked for in any case to the next.
STEP = 100


def _reach(ids: Iterable[str]) -> dict[str, int]:
    """The length of the longest of these tokens, by their last three characters; shorter tokens by all of theirs."""
    found: dict[str, int] = {}
    for t in ids:
        found[t[-3:]] = max(len(t), found.get(t[-3:], 0))
    return found


class TrieEncoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.text = {i: t for t, i in v.ids.items()} | {i: t for t, i in v.specials.items()}
        self.n = max(self.text, default=0) + 1
        #: tokens inside a word, and those that end one (without the word end's mark), by their characters
        self.inner = {t: i for t, i in v.ids.items() if not (v.end and t.endswith(v.end) and len(t) > len(v.end))}
        self.final = {t[: -len(v.end)]: i for t, i in v.ids.items() if t not in self.inner} if v.end else self.inner
        self.inner_reach, self.final_reach = _reach(self.inner), _reach(self.final)
        #: by left token * n + right token: whether they stay apart; by -1 - token: whether its symbols merge to it
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def symbols_of(self, token: int) -> list[int]:
        t, ids = self.text[token], self.v.ids
        if self.v.end and t.endswith(self.v.end) and len(t) > len(self.v.end):
            body = t.removesuffix(self.v.end)
            return [ids[c] for c in body[:-1]] + [ids[body[-1] + self.v.end]]
        return [ids[c] for c in t]

    def merged(self, symbols: list[int]) -> list[int]:
        ranks = self.v.ranks
        while len(symbols) > 1:
            best = min(((r[0], i, r[1]) for i in range(len(symbols) - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))), default=None)
            if best is None:
                break
            symbols[best[1] : best[1] + 2] = [best[2]]
        return symbols

    def fits(self, key: int) -> bool:
        """What `pairs` keeps for this key, worked out by merging."""
        found = [-1 - key] if key < 0 else [*divmod(key, self.n)]
        known = self.pairs[key] = self.merged([x for t in found for x in self.symbols_of(t)]) == found
        return known

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of each of these distinct pieces, as little-endian 32-bit integers."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        inner, reach, final, final_reach = self.inner.get, self.inner_reach.get, self.final.get, self.final_reach.get
        known, fits, n = self.pairs.get, self.fits, self.n
        out: dict[str, bytes] = {}
        tokens: list[int] = [-1]  # by depth: last token of the prefix, -1 if not asked for yet, and where that token starts
        starts = [0]

        def state(piece: str, depth: int, ids: Callable[[str], int | None], longest: int) -> tuple[int, int]:
            for at in range(max(0, depth - longest), depth):
                if (t := ids(piece[at:depth])) is not None:
                    if not at:
                        key = -1 - t
                    else:
                        if (last := tokens[at]) < 0:
                            last, starts[at] = state(piece, at, inner, reach(piece[max(0, at - 3) : at], 2))
                            tokens[at] = last
                        key = last * n + t
                    if (ok := known(key)) or ok is None and fits(key):
                        return t, at
            raise ValueError(f"no token ends {piece[:depth]!r}")

        before = ""
        for piece in sorted(pieces):
            shared = 0
            for a, b in zip(before, piece):  # noqa: B905
                if a != b:
                    break
                shared += 1
            size = len(piece)
            del tokens[shared + 1 :], starts[shared + 1 :]
            tokens += [-1] * (size - len(tokens))
            starts += [0] * (size - len(starts))
            for depth in range(STEP, size, STEP):  # a long piece's states ask for few others at once
                if tokens[depth] < 0:
                    tokens[depth], starts[depth] = state(piece, depth, inner, reach(piece[depth - 3 : depth], 2))
            t, at = state(piece, size, final, final_reach(piece[-3:], 2))
            if at:
                found = [t]
                while at:
                    found.append(tokens[at])
                    at = starts[at]
                out[piece] = array("I", found[::-1]).tobytes()
            else:
                out[piece] = array("I", (t,)).tobytes()
            before = piece
        return out

    def learn(self, words: set[str]) -> None:
        """Adds the encodings of new words to what is kept."""
        known, old, split = self.words, self.old_words, {}
        for w in words:
            if (found := old.get(w)) is not None:
                known[w] = found
            else:
                split[w] = self.v.pieces(w)
        pieces, old = self.pieces, self.old_pieces
        new = {p for ps in split.values() for p in ps}.difference(pieces)
        pieces |= {p: found for p in new if (found := old.get(p)) is not None}
        pieces |= self.encode_pieces(new.difference(pieces))
        for w, ps in split.items():
            known[w] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])
        if len(pieces) > CACHED_PIECES:
            self.old_pieces, self.pieces = pieces, {}

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids (little-endian 32-bit) and decoded text of each text."""
        v = self.v
        parts = [[(p, None) if special else (p, v.words(p)) for p, special in v.split(t)] for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.old_words, self.words = self.words, {}
        every: set[str] = set()
        for t in parts:
            for _, words in t:
                if words:
                    every.update(words)
        self.learn(every.difference(self.words))
        ids_of, text, out = self.words.__getitem__, self.text.__getitem__, []
        for t in parts:
            ids = b"".join([x for p, words in t for x in ((array("I", [v.specials[p]]).tobytes(),) if words is None else map(ids_of, words))])
            out.append((ids, " ".join(map(text, array("I", ids)))))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a space, as a tokenizer without a decoder gives them."""
        return " ".join(self.text[i] for i in ids)


def encoder(path: str) -> TrieEncoder:
    return kept(f"trie {path}", lambda: TrieEncoder(vocabulary(path)))


#: Characters of the texts that are encoded at once.
BATCH_CHARS = 300_000


def _groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size > BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """docs with ids array<int> and decoded string."""

    @F.pandas_udf("struct<ids: array<int>, decoded: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(vocab_path)
        for texts in batches:
            found = [x for g in _groups(texts) for x in e.encode_batch(g)]
            yield pd.DataFrame({"ids": [np.frombuffer(b, "<i4") for b, _ in found], "decoded": [d for _, d in found]})

    found = docs.select(F.struct("*").alias("_row"), run(F.col(text)).alias("_e"))
    return found.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("ids", "decoded")], "_e.ids", "_e.decoded")


#: Rows of a batch whose texts are taken out of Arrow's memory at once.
ROWS = 500


def _texts(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).to_pylist()


def encoded_rows(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of doc_id, text: the rows leave a task in small batches. A task lets its encoder
    go when it ends: the next task of its executor may come to any of the workers that earlier stages left, and would add its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab_path)
        try:
            for batch in batches:
                at, doc_ids = 0, batch.column("doc_id")
                for group in _groups(_texts(batch.column("text"))):
                    found = e.encode_batch(group)
                    counts = np.array([len(b) // 4 for b, _ in found], np.int64)
                    ids = pa.array(np.frombuffer(b"".join([b for b, _ in found]), "<i4"))
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    shas = pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in found], pa.string())
                    columns = [doc_ids.slice(at, len(group)), pa.array(counts), pa.ListArray.from_arrays(ends, ids), shas]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded_sha256"])
                    at += len(group)
        finally:
            del e
            released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def digests(text: str | Column, vocab_path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): what encode() gives, without moving the ids."""

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(vocab_path)
        for texts in batches:
            rows = [
                (len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(d.encode("utf-8")).hexdigest())
                for g in _groups(texts)
                for b, d in e.encode_batch(g)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(F.col(text) if isinstance(text, str) else text)
