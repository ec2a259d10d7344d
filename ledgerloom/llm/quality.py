"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics are counted over the whole text: kinds of characters, words, lines, how much
repeats. Trees are grown level by level on histograms of binned statistics and kept as
flat arrays (feature, threshold, children, value), so a batch walks all trees with a few
numpy steps per level.

The fit takes at most ``FIT_ROWS`` labelled documents, those with the smallest hash of
their id; scoring covers every row. Labels are read from the training part only, and a
score depends on nothing but the text.

Edge cases: a null text is scored like the empty one; a label for an unknown document,
with a null id or a null quality is ignored; a document labelled twice counts once, with
the rounded mean of its labels; without any usable label every score is 0.5; with one
class only, every score is that class's smoothed share; repeated and very long texts are
rows like others; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

FIT_ROWS = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
RIDGE = 1.0
# Rows of a leaf: this many, or a fiftieth of a small fit, but two at least.
LEAST_ROWS = 20

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "letters", "upper", "digits",
    "space", "line_ends", "marks", "symbols", "beyond_ascii", "control", "entropy",
    "other_words", "marked_words", "upper_words", "digit_words", "stops", "commas",
    "line_words", "other_lines", "same_lines", "pipes", "other_marks", "word_spread",
    "short_lines", "stop_spread",
)
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2),
                      (b"0123456789", 3), (b" \t", 4), (b"\n\r", 5), (b".,;:!?'\"()-", 6)):
    for _c in _chars:
        _CLASS[_c] = _kind
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 7
_CLASS[128:] = 8


def statistics(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text, in the order of ``FEATURES``."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9)
    n = max(1, len(raw))
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    share = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    shape = _CLASS[raw]
    joined = np.append(shape, 4)
    word_end = np.flatnonzero((joined[1:] == 4) | (joined[1:] == 5)) if len(raw) else np.zeros(0, int)
    last = shape[word_end]
    commas, stops = counts[44], counts[46] + counts[33] + counts[63]
    marks = counts[33:48].sum() - commas - counts[46]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / w, float((lengths > 15).sum()) / w,
        kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n,
        kinds[7] / n, kinds[8] / n, kinds[0] / n, float(-(share * np.log2(share)).sum()),
        len(set(words)) / w, float((last == 7).sum()) / w,
        float(sum(x.isupper() for x in words)) / w, float(sum(x.isdigit() for x in words)) / w,
        stops / w, commas / w, len(words) / m, len(set(lines)) / m, 1 - len(set(lines)) / m,
        counts[124] / w, marks / w, float(lengths.std()) if len(lengths) else 0.0,
        float((line_lengths < 40).sum()) / m,
        float(line_lengths.std() / (1 + line_lengths.mean())) if len(lines) else 0.0,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t.encode()) for t in texts], np.float64).reshape(-1, len(FEATURES))


class Trees:
    """Boosted trees in flat arrays; node i of a tree has children 2i+1 and 2i+2."""

    def __init__(self, base: float, feature, threshold, value):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: all rows walk all trees together, a level at a time."""
        rows, trees = len(x), len(self.feature)
        node = np.zeros((rows, trees), np.int64)
        which = np.arange(trees)[None, :]
        for _ in range(DEPTH if trees else 0):
            feature = self.feature[which, node]
            right = x[np.arange(rows)[:, None], feature] > self.threshold[which, node]
            node = 2 * node + 1 + right
        total = self.base + (self.value[which, node].sum(axis=1) if trees else np.zeros(rows))
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting with second-order gains on histograms."""
    if len(y) == 0:
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(ones / (1 - ones)))
    size = 2 ** (DEPTH + 1) - 1
    if y.min() == y.max():
        return Trees(base, np.zeros((0, size), int), np.zeros((0, size)), np.zeros((0, size)))
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    spot = binned + np.arange(x.shape[1]) * BINS  # one flat histogram for all features
    width = x.shape[1] * BINS
    least = max(2, min(LEAST_ROWS, len(y) // 50))
    margin = np.full(len(y), base)
    feature = np.zeros((trees, size), np.int64)
    threshold = np.full((trees, size), np.inf)
    value = np.zeros((trees, size))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = 2 ** level - 1, 2 ** level
            at = ((node - first)[:, None] * width + spot).ravel()

            def histogram(weights):
                flat = np.bincount(at, np.repeat(weights, x.shape[1]), n * width)
                return np.cumsum(flat.reshape(n, x.shape[1], BINS), axis=2)

            g, h, c = histogram(grad), histogram(hess), histogram(np.ones(len(y)))
            ga, ha, ca = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = (g ** 2 / (h + RIDGE) + (ga - g) ** 2 / (ha - h + RIDGE) - ga ** 2 / (ha + RIDGE))
            gain[(c < least) | (ca - c < least)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for i in range(n):
                f, b = divmod(int(best[i]), BINS)
                feature[t, first + i] = f
                if gain[i, f, b] > 1e-9 and b < len(edges[f]):
                    threshold[t, first + i] = edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        g = np.bincount(node, grad, size)
        h = np.bincount(node, hess, size)
        value[t] = -RATE * g / (h + RIDGE)
        margin += value[t][node]
    return Trees(base, feature, threshold, value)


def held_out(key):
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents that are not held out."""
    known = (labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_label"))
             .filter(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
             .groupBy("_id").agg(F.round(F.avg("_label")).alias("_label"))
             .withColumn("_turn", F.xxhash64("_id")).orderBy("_turn", "_id").limit(rows))
    # The ids are drawn before any text is read.
    drawn = known.select("_id", "_label").collect()
    label_of = {r["_id"]: r["_label"] for r in drawn}
    if not label_of:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    id_type = df.schema[key].dataType.simpleString()
    chosen = df.sparkSession.createDataFrame([(i,) for i in label_of], f"_id {id_type}")
    texts = (df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
             .join(F.broadcast(chosen), "_id", "left_semi"))  # at most ``rows`` ids

    def measure(batches):
        for batch in batches:
            values = matrix(batch["_text"].fillna(""))
            yield batch[["_id"]].assign(x=list(values), h=[
                zlib.crc32(t.encode()) for t in batch["_text"].fillna("")])

    found = texts.mapInPandas(measure, f"_id {id_type}, x array<double>, h long")
    one = found.groupBy("_id").agg(F.min(F.struct("h", "x")).alias("b")).select("_id", "b.x").collect()
    one.sort(key=lambda r: r["_id"])
    return fit(np.array([r["x"] for r in one]).reshape(-1, len(FEATURES)),
               np.array([label_of[r["_id"]] for r in one]))


def scored(df: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with the probability of class 1 in column ``name``."""
    @F.pandas_udf("double")
    def score(texts):
        return type(texts)(trees.score(matrix(texts)))

    return df.withColumn(name, score(F.coalesce(F.col(text), F.lit(""))))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row."""
    trees = train(df, labels, key, text)
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return scored(rows, trees, "_text", "score").select(
        F.col("_id").alias(key), held_out(F.col("_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
