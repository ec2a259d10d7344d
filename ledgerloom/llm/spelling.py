"""Spelling variants: words one edit apart, each grouped below its most frequent neighbour.

Words are runs of letters, lower-cased from A to Z only; one in ``MISSPELT`` occurrences, by
a checksum of document and run, loses a letter first. Counting is done in tasks that keep
bounded tables of counts, so a frequent word travels once per table and not once per use.

Near words are found by blocked Gram matrices. A word is a vector of letter counts; the
products of a block of such vectors give all squared distances in it. One replaced letter
makes a distance of 2 at equal length, one inserted letter 1 between adjacent lengths, so
pairs at most two apart in blocks of one length and the next are kept, and their letters
compared. Blocks are cut so that they do not grow with the vocabulary: one edit leaves the
first or the last half of a word as it was (the half of the shorter length), so a block
holds the words of two adjacent lengths whose halves fall into one bucket, and words with
both halves in common are counted by the first. A block still too large, a very common
beginning or ending, is dealt out as pairs of chunks. A task returns for each word how many
near words it met and the best of them.

A word's root is found by pointer doubling: its form's form, and so on; as counts at least
double along the way, a few rounds suffice.

Edge cases: null and empty texts have no words; a null id counts as an empty one in the
checksum; repeated rows count again; the runs of a very long text are taken in slices; very
long words make smaller chunks; ties of counts go to the smaller word in code-point order;
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import materialise
from .blocks import groups

RUN = "[a-zÀ-ÿ]"
LEAST_LENGTH = 5
LEAST_COUNT = 3
MISSPELT = 97
# Different words a task holds counts of before it hands them on; runs looked at in one go.
HELD_WORDS = 200_000
SLICE = 100_000
# Letters of a block on average, and of a chunk of a block that is far above it.
BLOCK_LETTERS = 10_000
CHUNK_LETTERS = 20_000
LETTERS = 26 + 64
# Rows of a Gram matrix made at once, and pairs whose letters are compared at once.
GRAM_ROWS = 512
COMPARED = 4_000_000


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``, how often it occurs; several rows may count one word."""
    # A run that is too short stays so without a letter.
    pattern = re.compile(RUN + "{%d,}" % LEAST_LENGTH)

    def handed(counts):
        some = [(w, n) for w, n in counts.items() if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())],
            names=["word", "n"])

    def work(batches):
        counts = Counter()
        for batch in batches:
            for doc, raw in zip(batch.column(0), batch.column(1)):
                whole = raw.as_py()
                if not whole:
                    continue
                # Bytes are lower-cased from A to Z only.
                found = map(re.Match.group, pattern.finditer(whole.encode().lower().decode()))
                base = crc32(f"{doc.as_py() or ''}:".encode())
                while runs := list(islice(found, SLICE)):
                    marks = np.fromiter((crc32(r.encode(), base) for r in runs), np.int64, len(runs))
                    for i in np.flatnonzero(marks % MISSPELT == 0).tolist():
                        gone = int(marks[i]) % len(runs[i])
                        runs[i] = runs[i][:gone] + runs[i][gone + 1:]
                    counts.update(runs)
                    if len(counts) > HELD_WORDS:
                        yield handed(counts)
                        counts.clear()
        yield handed(counts)

    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(
        work, "word string, n long")


def _letters(words, length: int) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _counted(letters: np.ndarray) -> np.ndarray:
    """Letter counts, in a type in which their products are exact."""
    n, length = letters.shape
    code = np.where(letters < 128, letters - 97, letters - 0xC0 + 26).astype(np.int64)
    at = (code + np.arange(n)[:, None] * LETTERS).reshape(-1)
    exact = np.float32 if length < 4000 else np.float64
    return np.bincount(at, minlength=n * LETTERS).reshape(n, LETTERS).astype(exact)


def _close(a: np.ndarray, b: np.ndarray, same: bool):
    """Pairs of rows whose squared distance is at most two."""
    b_square = (b * b).sum(axis=1)
    for i in range(0, len(a), GRAM_ROWS):
        part = a[i:i + GRAM_ROWS]
        distance = (part * part).sum(axis=1)[:, None] + b_square - 2 * (part @ b.T)
        l, r = np.nonzero(distance <= 2)
        l = l + i
        if same:
            l, r = l[l < r], r[l < r]
        yield l, r


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in one place, or b has one letter more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return front + back >= a.shape[1]


def near_pairs(words: list[str], chunk: np.ndarray, length: int, side: int, across: bool):
    """Places of the near words of one block that this block is the one to count.

    ``words`` have ``length`` letters or one more. On side 0 pairs share their first half,
    on side 1 only their last. With ``across``, pairs within a chunk are left to others.
    """
    size = np.array([len(w) for w in words])
    short, long = np.flatnonzero(size == length), np.flatnonzero(size > length)
    a = _letters([words[i] for i in short], length)
    b = _letters([words[i] for i in long], length + 1)
    a_count, b_count = _counted(a), _counted(b)
    half, step = length // 2, max(1, COMPARED // (length + 1))
    out = []
    for other, at, count, same in ((a, short, a_count, True), (b, long, b_count, False)):
        if not len(short) or not len(at):
            continue
        for l, r in _close(a_count, count, same):
            for i in range(0, len(l), step):
                x, y = l[i:i + step], r[i:i + step]
                front = (a[x, :half] == other[y, :half]).all(axis=1)
                mine = front if side == 0 else ~front
                if across:
                    mine &= chunk[short[x]] != chunk[at[y]]
                x, y = x[mine], y[mine]
                near = _one_edit(a[x], other[y])
                out.append((short[x[near]], at[y[near]]))
    if not out:
        return short[:0], short[:0]
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (minus its count, and the near word) of each word
    that has near words; ``vocabulary`` holds each word once, with its count ``n``."""
    sizes = vocabulary.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("c"))
    # Words of a length and the next one meet in the blocks of the shorter length.
    blocks = materialise(
        sizes.select(F.explode(F.array("l", F.col("l") - 1)).alias("length"), "c")
        .groupBy("length").agg(F.sum("c").alias("c"))
        .select("length", F.ceil(F.col("c") * F.col("length") / BLOCK_LETTERS).alias("buckets")),
        "lengths")
    length = F.length("word")
    halved = vocabulary.select(
        "word", "n", F.explode(F.array(length, length - 1)).alias("length")).filter(
        F.col("length") >= LEAST_LENGTH)
    half = F.floor(F.col("length") / 2).cast("int")
    sides = halved.select("word", "n", "length", F.posexplode(F.array(
        F.substring("word", F.lit(1), half), F.substring("word", length - half + 1, half)))
        .alias("side", "piece"))
    placed = sides.join(blocks, "length").select(
        "length", "side", F.pmod(F.xxhash64("piece"), F.col("buckets")).alias("bucket"), "word", "n")
    keys = ["length", "side", "bucket"]
    # Blocks far above the average, and in how many chunks they are cut.
    large = placed.groupBy(*keys).agg(F.count("*").alias("c")).select(
        *keys, F.ceil(F.col("c") * F.col("length") / CHUNK_LETTERS).alias("chunks")).filter("chunks > 1")
    cut = placed.join(large, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn(
        "chunk", F.pmod(F.xxhash64("word"), F.col("chunks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: (
        F.least("chunk", o) * F.col("chunks") + F.greatest("chunk", o)))
    dealt = cut.select(*keys, F.explode(pair).alias("pair"), "chunks", "chunk", "word", "n")

    def work(batches):
        for table in groups(batches, 4):
            if len(table) < 2:
                continue
            words, n = table["word"].to_pylist(), table["n"].to_numpy()
            chunks, number = table["chunks"][0].as_py(), table["pair"][0].as_py()
            a, b = near_pairs(words, table["chunk"].to_numpy(), table["length"][0].as_py(),
                              table["side"][0].as_py(), number // chunks != number % chunks)
            if not len(a):
                continue
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            of, near = np.concatenate([a, b]), np.concatenate([b, a])
            order = np.lexsort([rank[near], -n[near], of])
            of, near = of[order], near[order]
            some, first, count = np.unique(of, return_index=True, return_counts=True)
            best = near[first]
            yield pa.RecordBatch.from_arrays([
                pa.array([words[i] for i in some], pa.string()), pa.array(count.astype(np.int64)),
                pa.array(-n[best]), pa.array([words[i] for i in best], pa.string())],
                names=["word", "n_near", "less", "near"])

    order = [*keys, "pair"]
    met = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        work, "word string, n_near long, less long, near string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                   F.min(F.struct("less", "near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last form reached from it, of words that have a form."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        followed = materialise(links.join(above, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "roots")
        links = followed.select("word", "root")
        if not followed.filter("moved").limit(1).count():
            return links


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word."""
    vocabulary = materialise(
        word_counts(df, key, text).groupBy("word").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= LEAST_COUNT), "vocabulary")
    best_n = -F.col("best.less")
    takes = best_n >= 2 * F.col("n")
    told = materialise(vocabulary.join(near_words(vocabulary), "word", "left").select(
        "word", F.when(takes, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, best_n).alias("form_n")), "near_words")
    ends = roots(told.filter(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The checksum as its table of bytes, and near words by what is left without one letter.
ORACLE = """
with recursive bytes as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
           case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
runs as (
  select coalesce(cast(doc_id as varchar), '') || ':' as id,
         unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as raw
  from documents),
lowered as (
  select id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as uses
  from runs group by all),
coded as (
  select run, uses, flatten(list_transform(string_split(id || run, ''), lambda c:
           case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)) as code
  from lowered where length(run) >= 5),
hashed as (
  select run, uses, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), code),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from coded, bytes),
spelt as (
  select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2)
         else run end as word, uses
  from hashed),
words as (
  select word, cast(sum(uses) as bigint) as n from spelt
  where length(word) >= 5 group by word having sum(uses) >= 3),
cut as (
  select word, p, left(word, p - 1) || substr(word, p + 1) as rest
  from (select word, unnest(range(1, length(word) + 1)) as p from words)),
pairs as (
  select a.word, b.word as near from cut a join cut b
  on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select word, rest from cut where rest in (select word from words)
  union select rest, word from cut where rest in (select word from words)),
best as (
  select p.word, count(*) as n_near, max(w.n) as most
  from pairs p join words w on w.word = p.near group by p.word),
told as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near,
    (select min(p.near) from pairs p join words x on x.word = p.near
     where p.word = w.word and x.n = b.most and x.n >= 2 * w.n) as form
  from words w left join best b on b.word = w.word),
follow as (
  select word, coalesce(form, word) as root, form is not null as goes from told
  union all
  select f.word, coalesce(t.form, t.word), t.form is not null from follow f join told t on t.word = f.root
  where f.goes)
select t.word, t.form, f.root, t.n, t.n_near, w.n as form_n
from told t join follow f on f.word = t.word and not f.goes
left join words w on w.word = t.form
"""
