"""Token ids of whole texts through the tokenizers library, one call for each distinct word.

The vocabulary drops white space and never joins across it, nor across the border of letters and other signs, so a
text's ids are its words' ids one after another. Capital ASCII letters are lowered beforehand, as the vocabulary does,
save before a sign that could combine with them. Distinct words are told apart by a 64-bit hash, encoded by
the library, and kept for the texts that follow; the rest is array work.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from plumbline.llm import arrays

#: Words kept by a worker before it starts afresh, and the size of the table that finds them.
MOST_WORDS, TABLE_BITS = 2_000_000, 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII signs apart from the apostrophe, which may belong to the letters after it.
_ASCII_SIGN = np.zeros(256, bool)
_ASCII_SIGN[[c for c in range(0x21, 0x7F) if not _ASCII_WORD[c] and c != 0x27]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
#: First byte of the Latin letters from U+00C0 to U+00FF, and the second bytes there that are signs.
_LATIN, _LATIN_SIGNS = 0xC3, (0x97, 0xB7)
#: Bytes from here on may start a combining sign.
_COMBINING = 0xCC


def lowered(data: np.ndarray) -> np.ndarray:
    after = np.append(data[1:], np.uint8(0))
    return np.where(_CAPITAL[data] & (after < _COMBINING), data | np.uint8(0x20), data)


def sub_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`arrays.word_bounds`, with words also cut between letters and ASCII signs where that is sure."""
    starts, ends, of = arrays.word_bounds(data, offsets)
    if len(data) < 2:
        return starts, ends, of
    sign, plain = _ASCII_SIGN[data], _ASCII_WORD[data]
    latin = np.zeros(len(data), bool)  # last byte of such a letter
    latin[1:] = (data[:-1] == _LATIN) & (data[1:] != _LATIN_SIGNS[0]) & (data[1:] != _LATIN_SIGNS[1])
    begins = np.append(latin[1:], False)
    cut = np.flatnonzero(((plain | latin)[:-1] & sign[1:]) | (sign[:-1] & (plain | begins)[1:])) + 1
    cut = cut[~np.isin(cut, offsets)] if len(offsets) > 2 else cut
    # An apostrophe after the cut's sign run is left to the library together with what follows it.
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


class WordEncoder:
    """Encodes texts with the tokenizer file ``path``, without special tokens; their strings in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = 0
        self.slots = np.full(1 << TABLE_BITS, -1, np.int32)  # hash table from a word's hash to its number
        self.keys = np.zeros(MOST_WORDS, np.uint64)
        self.at, self.number = np.zeros(MOST_WORDS, np.int64), np.zeros(MOST_WORDS, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 20, np.uint32), 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each known word, else -1."""
        mask = np.uint64((1 << TABLE_BITS) - 1)
        slot = (key & mask).astype(np.int64)
        got = self.slots[slot]
        wrong = np.flatnonzero((got >= 0) & (self.keys[got] != key))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << TABLE_BITS) - 1)
            got[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self.keys[got[wrong]] != key[wrong])]
        return got

    def _place(self, key: np.ndarray, word: np.ndarray) -> None:
        slot = (key & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = self.slots[slot[todo]] < 0
            self.slots[slot[todo[free]]] = word[todo[free]]  # of several for one slot, the last stays
            lost = self.slots[slot[todo]] != word[todo]
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & ((1 << TABLE_BITS) - 1)

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). Words of plain letters go to the library many at a time: each ends with
        the only id that marks a word's end."""
        raw = data.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        letters = [w.isalpha() and max(w) < "\u0100" for w in words]
        plain = [i for i, x in enumerate(letters) if x]
        other = [i for i, x in enumerate(letters) if not x]
        joined = [" ".join([words[i] for i in plain[k : k + 256]]) for k in range(0, len(plain), 256)]
        got = [e.ids for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        many = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
        stops = np.flatnonzero(self.ends_word[many]) + 1
        if len(stops) != len(plain):
            raise ValueError("this vocabulary doesn't mark the ends of words")
        few = [e.ids for e in self.library.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        number = np.zeros(len(words), np.int64)
        number[plain] = np.diff(stops, prepend=0)
        number[other] = np.fromiter(map(len, few), np.int64, len(few))
        first = np.cumsum(number) - number
        ids = np.zeros(int(number.sum()), np.uint32)
        ids[arrays.expand(first[plain], number[plain])] = many
        ids[arrays.expand(first[other], number[other])] = np.fromiter(chain.from_iterable(few), np.uint32, int(number[other].sum()))
        return ids, number

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        data = lowered(data)
        starts, ends, of = sub_words(data, offsets)
        key = arrays.word_hashes(data, starts, ends)
        word = self._find(key)
        if (new := np.flatnonzero(word < 0)).size:
            _, first = np.unique(key[new], return_index=True)
            if self.known + len(first) > MOST_WORDS:
                self.forget()
                new = np.arange(len(key))
                _, first = np.unique(key, return_index=True)
            if len(first) > MOST_WORDS:  # one very long text: no sharing
                ids, number = self._encode_words(data, starts, ends)
                return ids, np.concatenate([[0], np.cumsum(number)])[of]
            self._learn(data, starts, ends, key, new[first])
            word[new] = self._find(key[new])
        number = self.number[word]
        ids = self.ids[arrays.expand(self.at[word], number)]
        return ids, np.concatenate([[0], np.cumsum(number)])[of]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, first: np.ndarray) -> None:
        ids, number = self._encode_words(data, starts[first], ends[first])
        word = np.arange(self.known, self.known + len(first))
        self.keys[word] = key[first]
        self.number[word] = number
        self.at[word] = self.n_ids + np.cumsum(number) - number
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        self.known += len(first)
        self._place(key[first], word.astype(np.int32))


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder: words that one task has learnt serve the tasks after it."""
    return WordEncoder(path)
