import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import components, queries, simhash
from tests.llm.plain import smallest_reachable


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64(b" ".join(words[i:i + n]), 42).intdigest()
              for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(ids, texts):
    prints = [plain_print(t) for t in texts]
    root = smallest_reachable(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    known = {}
    for r, i in zip(root, ids):
        if i is not None:
            known[r] = min(known.get(r, i), i)
    return sorted(((i, f"{p:016x}", known.get(r)) for i, p, r in zip(ids, prints, root)),
                  key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    result = got(queries.QUERIES["op7_simhash"](spark, sf))
    assert result == expected([r.doc_id for r in rows], [r.text for r in rows])
    assert len({c for _, _, c in result}) < len(rows)


def test_nulls_empty_long_repeated(docs):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \n", "one two", "ONE two", "É one two three four", long, long + " x",
             "a b c d e", "a b c d e"]
    ids = [7, 6, None, 5, 4, 3, 2, 1, 9, 9]
    df = docs(texts, ids=ids).selectExpr("*", "1 AS _fp", "2 AS fingerprint", "3 AS component_id")
    assert got(simhash.near_copies(df)) == expected(ids, texts)
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_full_nodes_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 64)
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 12, dtype=np.uint64)
    points = set()
    for b in base:
        for _ in range(120):
            flips = random.choice(64, random.integers(0, 9), replace=False)
            points.add(int(b) ^ sum(1 << int(f) for f in flips))
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "_fp long")
    label = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    root = smallest_reachable(points, lambda i, j: (points[i] ^ points[j]).bit_count() <= 4)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(label.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_groups_are_pruned_and_linked_whole():
    points = np.arange(200, dtype=np.uint64)
    a, b = simhash.links_of_node(points)
    root = smallest_reachable(points, lambda i, j: int(points[i] ^ points[j]).bit_count() <= 4)
    assert set(root) == {0} and set(a.tolist()) == set(range(1, 200)) and set(b.tolist()) == {0}


def test_gray_rank_orders_one_bit_apart():
    ranked = np.arange(64, dtype=np.uint64)[np.argsort(simhash.gray_rank(np.arange(64, dtype=np.uint64)))]
    assert all(int(x ^ y).bit_count() == 1 for x, y in zip(ranked, ranked[1:]))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5)]
    df = spark.createDataFrame(links, "src long, dst long")
    rows = {r.node: r.root for r in components.components(df).collect()}
    assert rows == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 300)}}
    assert components.components(df.limit(0)).count() == 0


# --- near copies by similarity --------------------------------------------------------

def plain_shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def alike(a, b):
    """Similarity 0.8 or more; texts without words are alike."""
    return 10 * len(a & b) >= 8 * len(a | b)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + 1] = rng.choice([[], [f"e{rng.randrange(10 ** 6)}"], [out[at], f"e{rng.randrange(10 ** 6)}"]])
    return out


def test_lightly_edited_copies_go(spark, docs):
    rng = random.Random(11)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 200, 500)))]
        texts.append(" ".join(words))
        # Up to the point where the similarity is about 0.8.
        texts += [" ".join(edited(rng, words, rng.randrange(1, 1 + len(words) // 45))) for _ in range(4)]
    texts += ["", None, "  ", "one two", "One  TWO", "one two three"]
    sets = [plain_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    root = smallest_reachable(sets, lambda i, j: alike(sets[i], sets[j]))
    want = {i for i, r in enumerate(root) if r == i}
    got = {r.doc_id for r in simhash.deduplicate_similar(docs(texts)).collect()}
    assert want <= got and len(links) > 200
    # Every text that had to go has gone, but for a few that are just similar enough.
    assert len(got - want) <= 0.03 * (len(texts) - len(want))


def test_a_large_group_of_near_copies(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 64)
    rng = random.Random(3)
    words = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = [" ".join(edited(rng, words, 1)) for _ in range(400)] + ["quite another text of some more words"]
    kept = [r.doc_id for r in simhash.deduplicate_similar(docs(texts)).collect()]
    assert sorted(kept) == [0, 400]


def test_long_texts_are_hashed_in_slices(monkeypatch):
    rng = random.Random(5)
    text = " ".join(f"W{rng.randrange(99)}" for _ in range(5000)).encode()
    whole = simhash.fingerprint(text), simhash.shingle_set(text).tolist()
    monkeypatch.setattr(simhash, "WHOLE_BYTES", 100)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert (simhash.fingerprint(text), simhash.shingle_set(text).tolist()) == whole
    monkeypatch.setattr(simhash, "SLICE", 2)
    assert simhash.fingerprint(text) == whole[0]


def test_spanning_pairs_hold_together_what_is_near():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, (6, 2)).astype(np.uint64)
    points = np.repeat(base, 30, axis=0)
    for row in points:
        for bit in rng.integers(0, 128, rng.integers(0, 12)):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    a, b = simhash.spanning_pairs(points)
    near = lambda i, j: int(np.bitwise_count(points[i] ^ points[j]).sum()) <= simhash.WIDE_BITS
    assert all(near(i, j) for i, j in zip(a, b))
    root = smallest_reachable(range(len(points)), near)
    found = {frozenset((int(i), int(j))) for i, j in zip(a, b)}
    assert smallest_reachable(range(len(points)), lambda i, j: frozenset((i, j)) in found) == root


def test_large_nodes_give_every_near_pair_that_is_not_linked_yet(spark):
    """Forest edges that fail the check must not hide pairs that would pass it."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2 ** 63, size=(1, 2), dtype=np.int64).view(np.uint64)
    points = np.repeat(base, 60, axis=0)
    for i in range(60):
        for bit in rng.choice(96, size=rng.integers(4, 22), replace=False):
            points[i, bit // 48] ^= np.uint64(1) << np.uint64(16 + bit % 48)
    df = spark.createDataFrame([(i, int(a), int(b), i % 2) for i, (a, b) in enumerate(points.view(np.int64).tolist())],
                               "_id long, _a long, _b long, _class long")
    near = {(i, j) for i in range(60) for j in range(i + 1, 60)
            if np.bitwise_count(points[i] ^ points[j]).sum() <= simhash.WIDE_BITS}

    def pairs(found):
        return {(r.src, r.dst) for r in found.collect()}

    first = pairs(simhash.candidate_pairs(df))
    assert first < near
    alone = df.select("_id", "_a", "_b", F.col("_id").alias("_class"))
    assert first | pairs(simhash.candidate_pairs(alone, classes="_class")) == near
    assert pairs(simhash.candidate_pairs(df, classes="_class")) == {(i, j) for i, j in near if (i + j) % 2}
    whole = df.withColumn("_class", F.lit(0).cast("long"))
    assert not pairs(simhash.candidate_pairs(whole, classes="_class"))


def around_the_similarity(rng, n=240):
    """Texts of one source with up to four words replaced: some pairs are similar, most are not."""
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    out = []
    for _ in range(n):
        text = list(words)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 4, 4, 4))):
            text[at] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(text))
    return out


def test_a_group_around_the_similarity_gives_no_pairs_of_its_square(spark, docs, monkeypatch):
    texts = around_the_similarity(random.Random(19))
    rows = {}

    def counted(df, name):
        out = materialise(df, name)
        rows[name] = max(rows.get(name, 0), out.count()) if {"src", "dst"} <= set(out.columns) else 0
        return out

    materialise = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", counted)
    got = {r.doc_id for r in simhash.deduplicate_similar(docs(texts)).collect()}
    # Forests of the nodes, which share most links, and none of the 28,680 pairs beyond them.
    assert max(rows.values()) < len(simhash.WIDE_MASKS) * len(texts)
    sets = [plain_shingles(t) for t in texts]
    near = [simhash.shingle_set(t.encode()) for t in texts]
    prints = np.array([[simhash._majority([s]), simhash._majority([simhash._mixed(s)])] for s in near], np.uint64)

    apart = prints[:, None] ^ prints[None]
    meet = (apart.view(np.uint8).reshape(len(texts), len(texts), 2, 8) == 0).sum(axis=3).max(axis=2) >= 2
    meet &= np.bitwise_count(apart).sum(axis=2) <= simhash.WIDE_BITS
    linked = {(i, j) for i, j in np.argwhere(meet).tolist() if alike(sets[i], sets[j])}
    # No link among near texts is lost.
    assert got == {i for i, r in enumerate(smallest_reachable(sets, lambda i, j: (i, j) in linked)) if r == i}


def test_links_across_join_what_all_pairs_join(spark, monkeypatch):
    rng = random.Random(23)
    texts = around_the_similarity(rng, 80)
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    prints = np.array([[simhash._majority([s]), simhash._majority([simhash._mixed(s)])] for s in sets], np.uint64)
    classes = [i % 40 for i in range(80)]
    facts = np.array([[*simhash.parities(s), len(s)] for s in sets], np.uint64)
    points = spark.createDataFrame(
        [(i, *row, classes[i]) for i, row in enumerate(np.hstack([prints, facts]).view(np.int64).tolist())],
        "_id long, _a long, _b long, _p long, _q long, _n long, _class long")
    told = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "_id long, _set array<long>")
    pairs = [(r.src, r.dst) for r in simhash.candidate_pairs(points, classes="_class").collect()]
    good = {frozenset(p) for p in pairs if alike(set(sets[p[0]].tolist()), set(sets[p[1]].tolist()))}

    def joined(links):
        return smallest_reachable(range(80), lambda i, j: classes[i] == classes[j] or frozenset((i, j)) in links)

    near = simhash.points_across(points, "_class", 0.8).collect()
    assert {i for p in good for i in p} <= {r._id for r in near} <= {i for p in pairs for i in p}
    for i, j in pairs:
        apart = np.bitwise_count(simhash.parities(sets[i]) ^ simhash.parities(sets[j])).sum()
        assert apart <= len(np.setxor1d(sets[i], sets[j]))
    table = spark.createDataFrame(near, "_node long, _id long")
    # With one chunk for each node, then with many.
    for shingles in (simhash.NODE_SHINGLES, 2000):
        monkeypatch.setattr(simhash, "NODE_SHINGLES", shingles)
        found = {frozenset((r.src, r.dst)) for r in simhash.links_across(points, table, told, "_class", 0.8).collect()}
        assert found <= good and joined(found) == joined(good) and len(good) > len(found) > 0
