"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import table, worker_of

STATISTICS = [
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "distinct_pairs", "repeated_next",
    "log_lines", "repeated_lines", "line_length", "letters", "upper", "digits", "spaces", "marks", "exclaims", "pipes",
    "brackets", "beyond_ascii", "entropy", "short_words", "ended_sentences", "upper_words",
]

_KIND = np.zeros((8, 256))
_KIND[0, [*range(65, 91), *range(97, 123)]] = 1
_KIND[1, 65:91] = 1
_KIND[2, 48:58] = 1
_KIND[3, [32, 9, 10, 13]] = 1
_KIND[4, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_KIND[5, ord("!")] = 1
_KIND[6, ord("|")] = 1
_KIND[7, [ord(c) for c in "<>{}[]()=;/\\#@_*"]] = 1


def statistics(text: bytes) -> list[float]:
    """STATISTICS of one whole text; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, upper, digits, spaces, marks, exclaims, pipes, brackets = (_KIND @ counts / n).tolist()
    share = counts[counts > 0] / n
    words = text.split() or [b""]
    m, by_word = len(words), Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x] or [b""]
    lengths = list(map(len, words))
    return [
        np.log1p(n), np.log1p(m), sum(lengths) / m, min(max(lengths), 1000), len(by_word) / m ** 0.9, max(by_word.values()) / m,
        len(pairs) / max(1, m - 1), again / m, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines), letters, upper,
        digits, spaces, marks, exclaims, pipes, brackets, counts[128:].sum() / n, float(-(share * np.log2(share)).sum()),
        sum(x <= 2 for x in lengths) / m, (counts[46] + counts[33] + counts[63]) / m, sum(w.isupper() for w in words) / m,
    ]


class Trees:
    """Boosted trees flattened into arrays (tree, node): node k's children are 2k + 1 and 2k + 2, leaves are last."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, bias: float, depth: int):
        self.feature, self.threshold, self.leaf, self.bias, self.depth = feature, threshold, leaf, bias, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row; all rows and trees go down a level at a time."""
        trees = np.arange(len(self.feature))
        total = np.full(len(x), self.bias)
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                over = part[np.arange(len(part))[:, None], self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + over
            total[i : i + 4096] += self.leaf[trees, node - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss, second-order gains, histograms of gradients over quantile bins, trees grown level by level."""
    n, f = x.shape
    inner = 2**depth - 1
    feature, threshold = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, 2**depth))
    rate1 = (y.sum() + 1) / (n + 2)
    bias = float(np.log(rate1 / (1 - rate1)))
    if n == 0 or y.min() == y.max():
        return Trees(feature, threshold, leaf, bias, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(f) * bins
    margin = np.full(n, bias)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            width, first = 2**d, 2**d - 1
            cell = (node - first)[:, None] * (f * bins) + flat
            sums = [np.bincount(cell.ravel(), np.repeat(w, f), width * f * bins).reshape(width, f, bins) for w in (g, h)]
            left_g, left_h = (s.cumsum(2) for s in sums)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < least) | (all_h - left_h < least)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6:
                    feature[r, first + k], threshold[r, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[r, node]] > threshold[r, node])
        node -= inner
        leaf[r] = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        margin += leaf[r, node]
    return Trees(feature, threshold, leaf, bias, depth)


def _statistics_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("quality")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t.as_py() or b"") for t in b.column("text")], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out() -> Column:
    """Rows kept from training: crc32 of doc_id as text divides by 5 (a null doc_id is kept out too)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on at most `max_rows` labelled documents outside the held-out fifth, those first by a hash of doc_id.

    The bound holds at every size of the corpus: the sampled ids can be broadcast and their statistics, some 4 MB, fit the
    driver. A label that is null is no label; of repeated ones the smallest counts.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = _statistics_of(texts).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id", "x")).limit(max_rows).select("x", "quality").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return boost(x, rows["quality"].to_numpy(float))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of `docs` with score and predicted (1 if score >= 0.3), where they lie; columns of `docs` that have these
    names, in whatever case, are replaced. Only the text is looked at; a null text counts as empty, rows that repeat are
    scored alike, an empty table gives no rows. Without labels of both kinds the score is the labels' smoothed mean."""
    columns = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    names = [f.name for f in columns]
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("quality")
        for b in batches:
            if b.num_rows:
                x = np.array([statistics((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(where)], float)
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.3).astype(np.int32))], names=[*names, "score", "predicted"])

    kept = docs.select(*[docs[n] for n in names])
    schema = type(docs.schema)([*columns])
    return kept.mapInArrow(run, schema.add("score", "double").add("predicted", "integer"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    # Scores come from statistics alone, so the text is dropped in the same task.
    scored = _scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _scores(docs: DataFrame, model: Trees) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("quality")
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t.as_py() or b"") for t in b.column("text")], float)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
