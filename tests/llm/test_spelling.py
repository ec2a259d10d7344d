import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import spelling

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def edits(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        row, before = [i], row
        for j, y in enumerate(b, start=1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain(texts):
    counts = Counter()
    for i, text in texts:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = raw.translate(UPPER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def told(df):
    return sorted((tuple(r) for r in spelling.variants(df).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def written(seed, letters, lengths, words, uses):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(words)]
    texts = []
    for i in range(30):
        drawn = []
        for _ in range(uses):
            w = stems[min(int(rng.expovariate(3 / words)), words - 1)]
            at = rng.randrange(len(w))
            w = rng.choice([w, w, w, w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:],
                            w[:at] + rng.choice(letters) + w[at + 1:], w.upper()])
            drawn.append(w)
        texts.append((i, rng.choice([" ", "-", "'", "7"]).join(drawn)))
    return texts


@pytest.mark.parametrize("letters,lengths", [("ab", (5, 6, 7)), ("abcdeé", (5, 6, 8)), ("aÀÿ×xyz", (4, 5, 9, 12))])
def test_against_all_pairs(spark, docs, letters, lengths):
    texts = written(letters, letters, lengths, 40, 120)
    df = docs([t for _, t in texts])
    assert told(df) == plain(texts)


def test_small_blocks_and_chunks_count_each_pair_once(spark, docs, monkeypatch):
    texts = written("x", "abc", (5, 6, 7, 8), 60, 150)
    df, want = docs([t for _, t in texts]), plain(texts)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", 150)
    monkeypatch.setattr(spelling, "CHUNK_LETTERS", 60)
    assert told(df) == want
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    monkeypatch.setattr(spelling, "SLICE", 7)
    assert told(df) == want


def test_forms_are_followed_to_the_last(spark, docs):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    text = " ".join(" ".join([w] * 3 * 2 ** i) for i, w in enumerate(chain))
    got = told(docs([text], ids=[5]))
    assert got == plain([(5, text)])
    assert {r[2] for r in got if r[1] or r[0] == "bbbcc"} == {"bbbcc"}


def test_long_words(spark, docs):
    word = "ab" * 3000
    other = word[:10] + "c" + word[10:]
    text = " ".join([word] * 9 + [other] * 4 + [other[:-1] + "z"] * 3)
    got = told(docs([text], ids=[1]))
    assert got == plain([(1, text)]) and len(got) == 3


def test_gram_products_are_squared_distances():
    rng = np.random.default_rng(1)
    letters = rng.choice(list(range(97, 123)) + list(range(0xC0, 0x100)), (50, 7)).astype(np.uint32)
    counts = spelling._counted(letters)
    assert counts.sum(axis=1).tolist() == [7] * 50
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if ((counts[i] - counts[j]) ** 2).sum() <= 2}
    got = {p for l, r in spelling._close(counts, counts, True) for p in zip(l.tolist(), r.tolist())}
    assert got == want


def test_nulls_empty_and_clashing_names(spark, docs):
    texts = [(1, "where where where Where"), (None, "there there there there there there there there"),
             (2, None), (3, ""), (4, "12 34 !"), (4, "wheré wheré wheré"), (4, "wheré wheré wheré")]
    df = docs([t for _, t in texts], ids=[i for i, _ in texts])
    extra = df.withColumns({c: F.lit("x") for c in ("word", "n", "form", "root", "id", "length", "near")})
    assert told(df) == plain(texts) == told(extra)
    assert told(df.limit(0)) == []
