"""Token ids of texts by a public tokenizer, with a cache of word pieces in each Python worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END = 1  # id behind every document
# A worker keeps two generations of so many words: a full one becomes the old one, from which words still in use move on.
CACHE_WORDS = 400_000

_SPACE = re.compile("[\x20\x09-\x0D]+")
# Texts with these are not taken apart further than at spaces: characters that str.split takes for white space and the
# tokenizer doesn't, a letter whose lower case depends on its place, and what special tokens begin with.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")
# ASCII punctuation behind a letter: the tokenizer always cuts between them.
_EDGE = re.compile("[!-&(-/:-@\\[-`{-~](?<=[^\\W\\d_].)", re.S)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """`encode_all(texts)`: ids of each text as little-endian unsigned 32-bit bytes. White space separates words for the tokenizer, so ids come word by word."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: set[str]) -> None:
        fresh = []
        for word in missing:
            known = self.old.get(word)
            if known is not None:
                self.words[word] = known
            elif word.isalpha():
                fresh.append(word)
            else:
                self.words[word] = self._plain(word)
        for lo in range(0, len(fresh), 500):  # words of letters, many at a time
            part = fresh[lo:lo + 500]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, piece = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
            cuts = [0, *(4 * (np.flatnonzero(piece[1:] != piece[:-1]) + 1)).tolist(), len(ids)]
            if len(cuts) == len(part) + 1:
                self.words.update((w, ids[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
            else:  # a word of several pieces among them
                self.words.update((w, self._plain(w)) for w in part)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words, self.old = {}, self.words
        split = [[] if not t else [w for w in _SPACE.split(t) if w] if any(x in t for x in _ODD) else _EDGE.sub(r" \g<0>", t.lower()).split()
                 for t in texts]
        self._learn(set().union(*split).difference(self.words))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    return Encoder(path, plain_specials)
