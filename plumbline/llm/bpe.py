"""Byte-pair encoding and decoding with a word-end vocabulary, from the merges in its file.

A text is put into composed form and lower case and cut into words (letters, single digits, runs of other signs); a word's
UTF-8 bytes are its first parts, the last of which carries the word's end. A short word has its parts and, in an array beside
them, the rank of each pair of neighbours: the least rank is looked up, the bound between its two parts deleted, and the
ranks on both sides are read anew, until no pair has one. Many words are worked on side by side, a row of the arrays each.
Scanning costs the square of a word's length, so words beyond ``SHORT`` bytes keep their pairs in a heap and their parts in a linked list instead, with the same merges.

Workers remember the ids of short runs between blanks, and start afresh beyond ``MOST_RUNS``; texts are cut at white space into
stretches of about ``STRETCH`` characters, so that a very long text needs no more memory than its ids.

Edge cases: a null text is empty and has no ids, and decodes to an empty text; special tokens' strings in a text become those
tokens, as the library does unless it is told otherwise (``special=False``: ordinary text); null and repeated doc_ids and
repeated rows each give their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import small_batches, table
from plumbline.llm.tokens import default_path

#: Bytes of a word up to which its ranks are scanned.
SHORT = 96
#: Runs that a worker remembers, and characters of a text that it handles at a time.
MOST_RUNS, STRETCH = 600_000, 1 << 20
#: What stands between ASCII blanks.
RUN = re.compile(r"[^\x09-\x0d\x20]+")
#: What the vocabulary's file says of words (a fixed value): contractions, letters, one digit, other signs; and a
#: line's end, which parts the runs. ``{later}``: signs that Python's tables don't know and the pattern library counts as letters.
WORD = r"(?V1)\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[{later}]]+|[\p{N}--[{later}]]|(?:[^\p{White_Space}\p{L}\p{N}]|[{later}])+"
BREAK = regex.compile(r"\p{White_Space}")
END = "</w>"
Batches = Iterator[pa.RecordBatch]


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself where it is printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


@lru_cache(1)
def word_pattern() -> regex.Pattern:
    """``WORD`` with letters and digits as Python's own tables have them, whose version the library follows."""
    signs = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    later = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", signs) if unicodedata.category(c) == "Cn"] or [0xFFFF]
    first = [c for c, before in zip(later, [-1, *later]) if c != before + 1]
    last = [c for c, after in zip(later, [*later[1:], -1], strict=True) if c + 1 != after]
    return regex.compile(WORD.replace("{later}", "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True))))


class Vocabulary:
    """The tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, added = held["model"], held["added_tokens"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = {i: token for token, i in (*ids.items(), *self.special.items())}
        self.words = word_pattern()
        # Ids of single bytes, within a word and at its end; the pairs that join, in order, with the rank of each.
        self.first = np.array([[ids[s + end] for s in byte_signs()] for end in ("", END)], np.int64)
        joins = [(ids[a], ids[b]) for a, b in model["merges"]]
        self.joins = {pair: rank for rank, pair in enumerate(joins)}
        self.merged = np.array([ids[a + b] for a, b in model["merges"]], np.int64)
        self.width, self.never = max(self.tokens) + 1, len(joins)
        pairs = np.array([a * self.width + b for a, b in joins], np.int64)
        self.pair_rank = np.argsort(pairs)
        self.pairs = pairs[self.pair_rank]
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.mark = regex.compile(f"({marks})") if special and marks else None
        self.known: dict[str, bytes] = {}
        self.passing: list[str] = []
        texts = [self.tokens[i].encode("utf-8") + b" " if i in self.tokens else b"" for i in range(max(self.tokens) + 1)]
        self.token_data = np.frombuffer(b"".join(texts), np.uint8)
        self.token_size = np.array([len(t) for t in texts], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size

    def scanned(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of short words, the bytes ``data[start : start + size]``, as many side by side as
        there are. A row of ``ranks`` belongs to the neighbours of the same row of ``parts``; both close up over a deleted bound."""
        n, most = len(starts), int(sizes.max())
        column, row = np.arange(most + 1), np.arange(n)
        parts = np.full((n, most + 1), -1, np.int64)
        inside = column[:most] < sizes[:, None]
        parts[:, :most][inside] = self.first[0][data[arrays.expand(starts, sizes)]]
        parts[row, sizes - 1] = self.first[1][data[starts + sizes - 1]]
        ranks = np.full((n, most + 1), self.never, np.int64)
        ranks[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        done, left = np.full((n, most), -1, np.int64), row
        while len(left):
            at = ranks.argmin(axis=1)
            least = ranks[row, at]
            if (ended := least == self.never).any():
                done[left[ended]] = parts[ended, :most]
                left, parts, ranks, at, least = (x[~ended] for x in (left, parts, ranks, at, least))
                row = np.arange(len(left))
                if not len(left):
                    break
            after = column + (column > at[:, None])
            parts = np.take_along_axis(np.pad(parts, ((0, 0), (0, 1)), constant_values=-1), after, 1)
            parts[row, at] = self.merged[least]
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=self.never), column + (column >= at[:, None]), 1)
            ranks[row, at] = self.rank(parts[row, at], parts[row, at + 1])
            before = np.flatnonzero(at)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], parts[before, at[before]])
        held = done >= 0
        return done[held].astype(np.int32), held.sum(axis=1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, ``never`` for those that don't join; a missing part is -1."""
        pair = left * self.width + right
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[found] == pair) & (left >= 0) & (right >= 0), self.pair_rank[found], self.never)

    def queued(self, word: bytes) -> np.ndarray:
        """Ids of a long word: entries of a heap that a merge has overtaken are passed over."""
        part = dict(enumerate(self.first[0][np.frombuffer(word[:-1], np.uint8)].tolist())) | {len(word) - 1: int(self.first[1][word[-1]])}
        after = {a: a + 1 for a in range(len(word) - 1)}
        before = {b: a for a, b in after.items()}

        def rank(a: int) -> int | None:
            return self.joins.get((part[a], part[after[a]])) if a in after else None

        heap = [(r, a) for a in part if (r := rank(a)) is not None]
        heapq.heapify(heap)
        while heap:
            r, a = heapq.heappop(heap)
            if a not in part or rank(a) != r:
                continue
            part[a] = int(self.merged[r])
            b = after.pop(a)
            del part[b], before[b]
            if b in after:
                after[a] = after.pop(b)
                before[after[a]] = a
            for at in (a, before.get(a)):
                if at is not None and (new := rank(at)) is not None:
                    heapq.heappush(heap, (new, at))
        return np.array([part[a] for a in sorted(part)], np.int32)

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as 32-bit integers; short words are taken together by length."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
        out: list[bytes] = [b""] * len(words)
        low = 0
        for high in (4, 8, 12, 16, 32, SHORT):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for k in range(0, len(some), 1 << 15):
                at = some[k : k + (1 << 15)]
                ids, n = self.scanned(data, starts[at], sizes[at])
                ids, ends = ids.tobytes(), 4 * np.cumsum(n)
                for i, a, b in zip(at.tolist(), (ends - 4 * n).tolist(), ends.tolist(), strict=True):
                    out[i] = ids[a:b]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.queued(raw[i]).tobytes()
        return out

    def learn(self, runs: Iterable[str]) -> None:
        """See to it that the ids of all ``runs``, which hold no blanks, are known. Long ones are known until the next call."""
        for run in self.passing:
            self.known.pop(run, None)
        runs = set(runs)
        new = runs - self.known.keys()
        if len(self.known) + len(new) > MOST_RUNS:
            self.known.clear()
            new = runs
        new = list(new)
        self.passing = [r for r in new if len(r) > SHORT]
        found = self.words.findall(normal("\n".join(new)))
        distinct = {w: i for i, w in enumerate(dict.fromkeys(found)) if w != "\n"}
        ids = dict(zip(distinct, self.words_ids(list(distinct)), strict=True))
        at, held = 0, []
        for word in found:
            if word == "\n":
                self.known[new[at]] = b"".join(held)
                at, held = at + 1, []
            else:
                held.append(ids[word])
        if new:
            self.known[new[at]] = b"".join(held)

    def split(self, text: str) -> Iterator[bytes | list[str]]:
        """A text's runs between blanks, a stretch at a time, and the ids of special tokens between them. Blanks part words
        for good: nothing composes or joins across one."""
        marked = self.mark is not None and any(t in text for t in self.special)
        for piece in self.mark.split(text) if marked else (text,):
            if marked and piece in self.special:
                yield np.int32(self.special[piece]).tobytes()
            else:
                yield from map(RUN.findall, stretches(piece))

    def taken(self, parts: Iterable[bytes | list[str]]) -> bytes:
        return b"".join([p if isinstance(p, bytes) else b"".join(map(self.known.__getitem__, p)) for p in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what their short parts have new is learnt together."""
        held = [None if len(t) > 2 * STRETCH else list(self.split(t)) for t in texts]
        self.learn(r for parts in held for p in parts or () if isinstance(p, list) for r in p)
        done = [None if parts is None else self.taken(parts) for parts in held]
        for i in [i for i, parts in enumerate(held) if parts is None]:
            out = []
            for part in self.split(texts[i]):
                if isinstance(part, list):
                    self.learn(part)
                out.append(self.taken([part]))
            done[i] = b"".join(out)
        return [np.frombuffer(ids, np.int32) for ids in done]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends) of the texts whose ids end at ``ends``: the tokens with a space between them, as this vocabulary's
        file names no decoder; unknown ids are left out."""
        known = (ids >= 0) & (ids < len(self.token_size))
        ids = np.where(known, ids, 0)
        size = np.where(known, self.token_size[ids], 0)
        at = self.token_at[ids]
        parts = [self.token_data[arrays.expand(at[k : k + STRETCH], size[k : k + STRETCH])] for k in range(0, len(ids), STRETCH)]
        data = np.concatenate(parts) if parts else self.token_data[:0]
        # Each token brings the space after it, the last one's is taken away.
        upto = np.concatenate([[0], np.cumsum(size)])[ends]
        filled = np.diff(upto, prepend=0) > 0
        return np.delete(data, upto[filled] - 1), upto - np.cumsum(filled)


def normal(text: str) -> str:
    """Composed form, in lower case sign by sign: a capital sigma at a word's end isn't special."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in stretches of ``size`` characters or some more, cut before white space."""
    start = 0
    while len(text) - start > size:
        cut = BREAK.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(2)
def vocabulary(path: str, special: bool) -> Vocabulary:
    """A worker's vocabulary, with the words that its earlier tasks have met."""
    return Vocabulary(path, special)


def encode_batches(path: str, special: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        words = vocabulary(path, special)
        for batch in arrays.pieces(batches):
            ids = words.encode([text or "" for text in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def decode_batches(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        words = vocabulary(path, True)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            n = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            data, ends = words.decode(lists.flatten().fill_null(-1).to_numpy(), np.cumsum(n))
            offsets = np.concatenate([[0], ends]).astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
            texts = pc.if_else(lists.is_valid(), texts, None)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """(doc_id, ids) of whole texts."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode_batches(path or default_path(), special), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its column ``ids``; null for null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decode_batches(path or default_path()), f"{kinds}, decoded string")


def op12_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(table(spark, sf_dir, "documents")))
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
