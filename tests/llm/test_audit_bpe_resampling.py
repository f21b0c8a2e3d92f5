"""Filter audit, byte-pair encoding and importance resampling against plain versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from test_operators import corpus, frame
from tokenizers import Tokenizer

from plumbline.llm import bpe, filter_audit, resampling
from plumbline.llm.tokens import default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"word{i % 7919}" for i in range(60_000))


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, s) for i, t, s in corpus(11, 90)]
    n = len(made)
    made += [(n, LONG, "s1"), (n + 1, LONG, "s2"), (n + 2, "MANY CAPITALS " * 80, "s2"), (n + 3, "a # b " * 60, "s0"), (n + 4, " ".join(map(str, range(200))), "s0")]
    return [*made, made[5], made[5], (None, made[0][1], None), (None, None, "s0"), (3, "two texts of one id", "s0")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


LANGS = ("de", "en", None, "")


def lang(i):
    return "en" if i is None else LANGS[i % 4]


@pytest.fixture(scope="module")
def labels(spark, rows):
    made = [(i, i % 3 % 2, int(i % 5 == 0)) for i, _, _ in rows if i is not None and i % 4] + [(1, 0, None), (None, 1, 1), (999_999, 1, 1)]
    return made, spark.createDataFrame(made, "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(set("#$%&*|") & set(t)),
            "E": i is not None and least[t] < i,
        }
        parts.setdefault(lang(i) or "", []).append((i, {f for f in fails if fails[f]}))
    for part, held in parts.items():
        shapley, done = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(held)
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(removed)
                fail = [d for d in held if f in d[1]]
                done.append((f, "".join(order), step, len(left), len(removed), len(fail) - len(removed), sum(d[1] == {f} for d in held), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)))
        yield from ((part, *d[1:], shapley[d[0]]) for d in done)


def test_audit_is_that_of_filtering_in_every_order(docs, rows, labels):
    by_lang = docs.selectExpr("doc_id", "text", "CASE pmod(doc_id, 4) WHEN 0 THEN 'de' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE 'en' END AS lang", "n_words", "row AS mask", "score AS n")
    got = filter_audit.orders(filter_audit.cells(by_lang, labels[1])).collect()
    assert Counter(map(tuple, got)) == Counter(plain_audit(rows, labels[0]))


def test_audit_of_nothing_and_of_copies_alone(spark, docs, labels):
    assert filter_audit.orders(filter_audit.cells(docs.limit(0), labels[1])).count() == 0
    many = spark.range(3000).selectExpr("id AS doc_id", "'one text' AS text", "'en' AS lang").union(spark.range(2000).selectExpr("0L", "'one text'", "'en'"))
    got = {(r["mask"]): r["n"] for r in filter_audit.cells(many, labels[1].limit(0)).collect()}
    assert got == {1: 2001, 17: 2999}


ODD = ["İstanbul ΟΔΟΣ Σ ς", "é ẛ̣ ﬁ", "a\x1cb\x85c d e​f", "it's we'll I'D x'sy ''s", "١٢٣ 4567 ½ Ⅷ", "漢字かな交じり 한국어", "👩‍👩‍👧 flag 🇩🇪", "́ start", "tab\t\x0b\x0cend", "a" * 3000, "é" * 500 + "!" * 700, "ab" * 90 + "xyz" * 40]
SPECIAL = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>c", "<|endoftext|", "<|ENDOFTEXT|>"]


def test_encoding_and_decoding_are_the_library_s(spark, docs, rows):
    library = Tokenizer.from_file(default_path())
    rng = random.Random(5)
    mixed = ["".join(chr(rng.choice((rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x300, 0x5FF), rng.randint(0x3040, 0x30FF), rng.randint(0x1F300, 0x1F5FF)))) for _ in range(60)) for _ in range(150)]
    texts = [t for _, t, _ in rows] + ODD + SPECIAL + mixed
    made = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(made)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want, t
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False), t
    library.encode_special_tokens = True
    as_text = bpe.encode(made.where(f"doc_id >= {len(rows)}"), special=False).collect()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in as_text)


def test_long_words_merge_as_short_ones_do():
    words, rng = bpe.Vocabulary(default_path()), random.Random(2)
    made = ["".join(rng.choice("aeinrst\u00e9") for _ in range(n)) for n in (1, 2, 5, 40, 96, 97, 300) for _ in range(20)]
    for word in made:
        raw = np.frombuffer(word.encode(), np.uint8)
        ids, n = words.scanned(raw, np.array([0]), np.array([len(raw)]))
        assert ids.tolist() == words.queued(word.encode()).tolist() and n.tolist() == [len(ids)]


def test_stretches_and_a_small_memory_change_nothing(monkeypatch):
    whole = bpe.Vocabulary(default_path()).encode([LONG])[0].tolist()
    assert "".join(bpe.stretches(LONG, 50)) == LONG and max(map(len, bpe.stretches(LONG, 50))) < 70
    monkeypatch.setattr(bpe, "MOST_RUNS", 10)
    small = bpe.Vocabulary(default_path())
    parts = list(bpe.stretches(LONG, 5000))
    assert [i for k in range(0, len(parts), 7) for ids in small.encode(parts[k : k + 7]) for i in ids.tolist()] == whole
    monkeypatch.setattr(bpe, "STRETCH", 3000)
    monkeypatch.setattr(bpe.stretches, "__defaults__", (3000,))
    assert small.encode(["one", LONG, ""])[1].tolist() == whole and len(small.known) < 3000


def test_decoding_leaves_unknown_ids_out(spark):
    ids = [[320, 99_999_999, -1, 49_407], [], None, [-5], [320, None, 321]]
    got = bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, ids array<int>")).orderBy("doc_id").collect()
    library = Tokenizer.from_file(default_path())
    want = [None if x is None else library.decode([i for i in x if i is not None and 0 <= i < 50_000], skip_special_tokens=False) for x in ids]
    assert [r["decoded"] for r in got] == want


def test_encoding_of_nothing(docs):
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def features(text):
    w = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resampling(rows, target, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x[1] for x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    made = []
    for i, text, _ in rows:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        made.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((m for m in made if m[5] >= 20), key=lambda m: (-m[3], m[0] is None, m[0], m[1]))
    for r, m in enumerate(able[: percent * len(able) // 100], 1):
        m[4] = r
    return Counter(tuple(m[:5]) for m in made)


@pytest.mark.parametrize("size", [resampling.TRIE_BYTES, 400])
def test_resampling_is_the_plain_one(spark, docs, rows, size):
    target = [rows[3][1], rows[7][1], None, "abc ABC Übc 12-3"]
    gain = resampling.gains(docs, frame(spark, [(i, t, "s") for i, t in enumerate(target)]))
    sums = {r["bucket"]: r["n"] for r in resampling.bucket_sums(docs, size=size).collect()}
    assert sums == Counter(zlib.crc32(f.encode()) % 10_000 for _, t, _ in rows for f in features(t)[1])
    scored = resampling.keyed(resampling.weigh(docs, gain, size)).cache()
    for percent in (0, 25, 100):
        got = resampling.draw(scored, percent).drop("n_words").collect()
        assert Counter(map(tuple, got)) == plain_resampling(rows, target, percent)


def test_sums_carried_along_paths_are_the_library_s():
    rng = random.Random(9)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 7, 8, 47, 48, 49, 500)]
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    state = np.array([rng.randrange(1 << 32) for _ in words], np.uint32)
    assert resampling.carried(state, data, ends - sizes, ends).tolist() == [zlib.crc32(w, int(s)) for w, s in zip(words, state, strict=True)]


def test_resampling_of_nothing_and_of_repeated_rows(spark, docs):
    none = docs.limit(0)
    gain = resampling.gains(none, none)
    assert gain.tolist() == np.zeros(10_000).tolist()
    assert resampling.draw(resampling.keyed(resampling.weigh(none, gain))).count() == 0
    same = spark.range(4000).selectExpr("7L AS doc_id", "repeat('one ', 30) AS text")
    got = resampling.draw(resampling.keyed(resampling.weigh(same, gain)))
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 1001)) and got.count() == 4000
