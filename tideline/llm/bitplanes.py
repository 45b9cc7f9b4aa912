"""Token ids in bit planes: encode documents, write fixed-size blocks of ids plane by plane, read them back.

Format (a folder): `chunks` and `index`, both Parquet.
chunks: one row a block of at most `block` ids: shard, chunk, first (position of its first id in the shard), n_ids,
planes (array<binary>: plane b holds bit b of each id, eight ids a byte, first id in the highest bit, compressed with
zstandard; as many planes as the block's largest id has bits), doc_ids, doc_ordinals (rank in the shard) and doc_starts
(place in the block) of the documents with ids in the block. A document may go on in following blocks.
index: the chunk index: shard, chunk, first, n_ids, start (position of its first id in the whole file).
Shards follow each other in ascending doc_id order, as do documents in a shard, and chunks.

Null text is the empty text: just the end id. Rows without doc_id come first, rows that share a doc_id are ordered by
their texts, and exact repetitions follow each other; each row is a document of its own. An empty table gives an empty
file and no rows. Only doc_id and text are read, so columns of any other name change nothing. A very long text costs about 200
bytes a word, for one text at a time.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.bpe_vocab import byte_symbols
from tideline.llm.common import kept, new_path, text_of

#: Ids a block.
BLOCK = 65_536
#: Word encodings in a generation: a worker keeps two, and a full one drops the one before.
CACHED_WORDS = 500_000
END_ID = 0

CHUNKS = "shard int, chunk int, first long, n_ids int, planes array<binary>, doc_ids array<long>, doc_ordinals array<long>, doc_starts array<int>"
CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]


class CachedTokenizer:
    """The tokenizers library behind a store of the words that it has encoded.

    The vocabulary's splitting always begins a piece at a single space between two other characters, so what lies
    between such spaces can be encoded apart from the rest. It also parts letters from the ASCII signs behind them, and
    letters alone are one piece: the library's model takes it without splitting it first. A tokenizer file that
    normalises or splits otherwise is refused."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        splits = settings["pre_tokenizer"] or {}
        if settings["normalizer"] or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex"):
            raise ValueError(f"{path}: not a byte-level vocabulary without normalisation")
        self.later: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.tokens, self.symbols = self.tokenizer.model.tokenize, byte_symbols()
        #: by id: does the token begin with a space
        self.lead = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.tokenizer.get_vocab_size())])

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, word: str) -> bytes:
        """The ids of letters with a space before them."""
        table = self.symbols
        piece = table[32] + word if word.isascii() else "".join([table[b] for b in (" " + word).encode()])
        return array("I", [t.id for t in self.tokens(piece)]).tobytes()

    def learn(self, words: set[str]) -> None:
        """Adds new words, each with a space before it. Others than letters with signs behind go to the library as one text, which
        is cut again where a token begins with a space."""
        later, older, signs, odd = self.later, self.older, self.signs, []
        for w in words:
            if (known := older.get(w)) is None:
                core = w.rstrip(punctuation)
                if not core.isalpha() or max(core) >= "\u0530":
                    odd.append(w)
                    continue
                if (known := later.get(core) or older.get(core)) is None:
                    known = later[core] = self.letters(core)
                if (tail := w[len(core) :]) not in signs:
                    if len(signs) > 10_000:
                        signs.clear()
                    signs[tail] = self.one_by_one([tail])[0] if tail else b""
                known += signs[tail]
            later[w] = known
        for i in range(0, len(odd), 5_000):
            part = odd[i : i + 5_000]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(self.lead[ids])
            if len(at) == len(part) and at[0] == 0:
                data, ends = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
                later.update(zip(part, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
            else:
                later.update(zip(part, self.one_by_one([" " + w for w in part]), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers. Texts with other white space around a blank go to the library whole."""
        if len(self.later) > CACHED_WORDS:
            self.older, self.later = self.later, {}
        docs, every = [], set()
        for t in texts:
            words = t.split(" ")
            ends = [words[0]]
            del words[0]
            if words and t[-1:].isspace():
                ends.append(" " + words.pop())
            every.update(words)
            docs.append((t, words, ends))
        self.learn({w for w in every.difference(self.later) if w and not w[0].isspace() and not w[-1].isspace()})
        at_ends, known, out = iter(self.one_by_one([e for d in docs for e in d[2]])), self.later.__getitem__, []
        for t, words, ends in docs:
            first, *last = [next(at_ends) for _ in ends]
            before_last = words[-1] if words else ends[0]
            try:
                if last and before_last[-1:].isspace():
                    raise KeyError(t)
                out.append(b"".join([first, *map(known, words), *last]))
            except KeyError:  # odd white space
                out += self.one_by_one([t])
        return out


def tokenizer(path: str) -> CachedTokenizer:
    return kept(f"tokenizer {path}", lambda: CachedTokenizer(path))


def to_planes(ids: np.ndarray, level: int = 1) -> list[bytes]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=level)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    return [pack.compress(np.packbits((ids >> np.uint32(b)) & np.uint32(1) != 0).tobytes()) for b in range(bits)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    ids = np.zeros(n, "<u4")
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(unpack.decompress(plane), np.uint8), count=n).astype("<u4") << np.uint32(b)
    return ids


#: Characters of the texts that are encoded at once.
BATCH_CHARS = 4_000_000


def _encoded(batches: Iterator[pd.DataFrame], path: str) -> Iterator[tuple[int | None, bytes]]:
    e, end = tokenizer(path), np.array([END_ID], "<u4").tobytes()
    for pdf in batches:
        ids, texts = pdf["doc_id"].array, pdf["text"].array
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < BATCH_CHARS):
                size += len(texts[to])
                to += 1
            for i, b in zip(ids[at:to], e.encode_batch(list(texts[at:to])), strict=True):
                yield (None if pd.isna(i) else int(i)), b + end
            at = to


def write_planes(docs: DataFrame, path: str, vocab_path: str, block: int = BLOCK) -> None:
    """Encodes doc_id, text and writes the format above to the folder `path`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        chunk, first, room, parts, held = 0, 0, block, [], []

        def out() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pd.DataFrame(
                [(shard, chunk, first, len(ids), to_planes(ids), [h[0] for h in held], [h[1] for h in held], [h[2] for h in held])],
                columns=CHUNK_COLUMNS,
            )

        for ordinal, (doc_id, data) in enumerate(_encoded(batches, vocab_path)):
            at = 0
            while at < len(data):
                take = data[at : at + 4 * room]
                held.append((doc_id, ordinal, block - room))
                parts.append(take)
                at += len(take)
                room -= len(take) // 4
                if not room:
                    yield out()
                    chunk, first, room, parts, held = chunk + 1, first + block, block, [], []
        if parts:
            yield out()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ranged.mapInPandas(run, CHUNKS).write.parquet(f"{path}/chunks")
    heads = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "first", "n_ids")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # a row a shard: as few as the writing tasks
    before = F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("_before"))
    heads.join(F.broadcast(shards), "shard").select("shard", "chunk", "first", "n_ids", (F.col("_before") + F.col("first")).alias("start")).write.parquet(
        f"{path}/index"
    )


def read_pieces(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Document pieces from the written folder: shard, ordinal, doc_id, chunk, start (in the whole file), n, crc32 of the
    piece's ids and, if asked, the ids themselves."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    starts = spark.read.parquet(f"{path}/index").filter("chunk = 0").select("shard", F.col("start").alias("_shard_start"))
    schema = "shard int, ordinal long, doc_id long, chunk int, start long, n long, crc long" + (", ids binary" if ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                data = memoryview(from_planes(r.planes, r.n_ids).tobytes())
                ends = [*map(int, r.doc_starts[1:]), r.n_ids]
                rows = []
                for doc_id, ordinal, a, b in zip(r.doc_ids, r.doc_ordinals, r.doc_starts, ends, strict=True):
                    piece = data[4 * int(a) : 4 * int(b)]
                    rows.append((r.shard, ordinal, doc_id, r.chunk, r.first + int(a), b - int(a), zlib.crc32(piece)) + ((bytes(piece),) if ids else ()))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["doc_id"]], "Int64")
                yield out

    found = chunks.mapInPandas(run, schema)
    return found.join(F.broadcast(starts), "shard").withColumn("start", F.col("start") + F.col("_shard_start")).drop("_shard_start")


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_joined(first: int, second: int, n_second: int) -> int:
    """The crc32 of two byte strings in a row from theirs: n_second zero bytes are applied to the first as a matrix power."""
    if not n_second:
        return first
    power = [0xEDB88320, *(1 << i for i in range(31))]  # by one zero bit
    bits = n_second * 8
    while bits:
        if bits & 1:
            first = _times(power, first)
        power = [_times(power, row) for row in power]
        bits >>= 1
    return first ^ second


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the written folder: doc_id, start, n_tokens, ids_crc32."""

    @F.pandas_udf("long")
    def joined(pieces: pd.Series) -> pd.Series:
        out = []
        for ps in pieces:
            crc, *rest = [(p["crc"], p["n"]) for p in ps]
            crc = crc[0]
            for c, n in rest:
                crc = crc32_joined(crc, c, 4 * n)
            out.append(crc)
        return pd.Series(out, dtype="int64")

    by_doc = read_pieces(spark, path, ids=False).groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("chunk", "n", "crc"))).alias("_pieces"),  # as many as the document has blocks
    )
    return by_doc.select("doc_id", "start", "n_tokens", joined("_pieces").alias("ids_crc32"))


def shuffled_planes(docs: DataFrame, vocab_path: str, block: int = BLOCK) -> DataFrame:
    """Writes docs to a new shared folder and returns what reading it back gives per document."""
    path = new_path(docs.sparkSession, "planes")
    write_planes(docs, path, vocab_path, block)
    return document_digests(docs.sparkSession, path)
