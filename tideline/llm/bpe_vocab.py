"""A byte-level BPE vocabulary with word ends, read from a tokenizer file, and the splitting of texts for it."""

from __future__ import annotations

import json
import re
import unicodedata

import regex

#: Fixed value: how the vocabulary's published settings split a normalised text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Python's split() takes these for white space, the tokenizer does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"

#: Below it (Latin-1 and Latin Extended-A to \u012F) a letter is one for all libraries, its lower case doesn't depend on
#: neighbours, and is one letter.
LATIN_END = "\u0130"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """ids: by token string. ranks: by (left id, right id), with the merged id. specials: strings matched in raw text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        kinds = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (j["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        splits = first.get("pattern", {}).get("Regex") == PIECES.pattern and [r["type"] for r in rest] == ["ByteLevel"]
        if kinds != ["NFC", "Replace", "Lowercase"] or not splits:
            raise ValueError(f"{path}: normalisation or splitting other than what is built in here")
        self.end = j["model"]["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(j["model"]["vocab"])
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(j["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.specials = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.symbols = byte_symbols()
        self.by_byte = dict(enumerate(self.symbols))
        self.special_pattern = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")")

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Parts of a text with whether each is a special token."""
        if not any(s in text for s in self.specials):
            return [(text, False)]
        return [(x, x in self.specials) for x in self.special_pattern.split(text) if x]

    def words(self, text: str) -> list[str]:
        """White-space separated words; normalisation and the splitting into pieces never cross white space."""
        if any(c in text for c in ODD_SPACE):
            return regex.split(r"[^\S\x1c-\x1f]+", text)
        return text.split()

    def pieces(self, word: str) -> list[str]:
        """A word's pieces after normalisation, in the vocabulary's byte symbols."""
        if word.isascii() and word.isprintable():  # the symbols are the characters themselves
            return [word.lower()] if word.isalpha() else PIECES.findall(word.lower())
        low = unicodedata.normalize("NFC", word)
        if max(low) < LATIN_END:
            low = low.lower()
            found = [low] if low.isalpha() else PIECES.findall(low)
        else:
            found = PIECES.findall("".join(c.lower() for c in low))  # by character: no final sigma
        return [p.encode("utf-8").decode("latin-1").translate(self.by_byte) for p in found]

    def first_symbols(self, piece: str) -> list[int]:
        """A piece's symbols before any merge; the last one carries the word end."""
        ids = self.ids
        return [ids[c] for c in piece[:-1]] + [ids[piece[-1] + self.end]]


def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
