"""Token ids of whole texts under a word-level BPE vocabulary file, word by word.

White space is dropped by this vocabulary and no token spans it, so the ids of a text
are those of its words, and a worker remembers the words it has met. Words of plain
letters go to a second encoder over the same merges, many at once; all others are
encoded by the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from docsluice.llm.common import once_per_worker

REMEMBERED = 100_000
# Letters whose lower case is one letter of the same normal form, and marks after them that stay in one token group.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = ".,;:!?*#%()-"
END = "\x00"


class WordEncoder:
    """Ids of words as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"]
        letters = _byte_letters()
        ranks, ends = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
        for token, number in model["vocab"].items():
            last = token.endswith(suffix)
            stem = token[: -len(suffix)] if last else token
            if all(letter in letters for letter in stem):
                ranks[bytes(letters[letter] for letter in stem) + END.encode() * last] = number
                ends[number] = last
        # The end mark joins the last letter before any merge, as its ids are the lowest of two bytes.
        self.plain = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.ends = ends

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [text.split() for text in texts]
        self._learn(list(set().union(*words).difference(self.known)))
        found = [b"".join(map(self.known.__getitem__, text)) for text in words]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return found

    def _learn(self, words: list[bytes]) -> None:
        plain, pieces, parts = [], [], []
        # No word holds a line end, so all are decoded at once.
        for word, text in zip(words, b"\n".join(words).decode("utf-8", "replace").split("\n")):
            stem = text.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or LATIN.fullmatch(stem)):
                plain.append(word)
                parts.append(stem)
                if len(stem) < len(text):
                    parts.append(text[len(stem) :])
                    pieces.append(2)
                else:
                    pieces.append(1)
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                self.known[word] = np.array(ids, "<u4").tobytes()
        if plain:
            ids = np.array(self.plain.encode_ordinary(END.join(parts).lower() + END), "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1)[np.cumsum(pieces) - 1] * 4
            data, first = ids.tobytes(), 0
            for word, end in zip(plain, ends.tolist()):
                self.known[word] = data[first:end]
                first = end


def word_encoder(path: str) -> WordEncoder:
    return once_per_worker(f"words {path}", lambda: WordEncoder(path))


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(byte): byte for byte in shown} | {chr(256 + place): byte for place, byte in enumerate(hidden)}
