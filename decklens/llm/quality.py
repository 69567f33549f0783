"""Quality rules: base rules on document statistics, and gradient-boosted trees over them.

The trees are trained on a bounded sample of labelled documents, with monotonic constraints on
chosen features, and stored as plain numpy node arrays that score a batch of rows at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklens.llm.common import as_bytes, pieces, slices

#: Labelled rows the trees are fitted on, at most (lowest hashes of doc_id).
TRAIN_ROWS = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_STOPS = b".,;:!?"

#: Feature -> direction in which quality may move as the feature grows (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "longest_word": -1,
    "symbols_per_word": -1,
    "duplicate_line_share": -1,
    "repeated_word_share": -1,
    "distinct_word_share": 0,
    "digit_share": -1,
    "upper_share": 0,
    "stop_share": 0,
    "non_ascii_share": 0,
    "words_per_line": 0,
    "other_symbol_share": -1,
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by runs of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    runs = np.zeros(n, np.uint64)
    for k in range(window):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # The hashes only nominate; the words themselves decide.
    places = np.flatnonzero(np.isin(runs, twice))
    found = [tuple(words[i : i + window]) for i in places]
    count = Counter(found)
    edges = np.zeros(len(words) + 1, np.int64)
    for i, run in zip(places, found):
        if count[run] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: bytes, n_chars: int) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text (UTF-8 bytes and its number of code points)."""
    words = text.split()
    n_words = len(words)
    lines = text.split(b"\n")
    filled = [line for line in lines if line.strip()]
    n_dup = len(filled) - len(set(filled))
    n_symbols = sum(text.count(bytes([s])) for s in _SYMBOLS)
    word_chars = n_chars - sum(text.count(bytes([s])) for s in _SPACES)
    n_repeat = repeated_words(words)
    size = max(len(text), 1)
    per_word = max(n_words, 1)

    def share(members: bytes) -> float:
        return (len(text) - len(text.translate(None, members))) / size

    letters_like = len(text.translate(None, _SPACES + _DIGITS + _STOPS + _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))))
    features = [
        float(np.log1p(n_words)), word_chars / per_word, float(max(map(len, words), default=0)), n_symbols / per_word,
        n_dup / max(len(filled), 1), n_repeat / per_word, len(set(words)) / per_word, share(_DIGITS), share(_UPPER),
        share(_STOPS), share(bytes(range(128, 256))), n_words / max(len(filled), 1), letters_like / size,
    ]
    return [n_words, word_chars, n_symbols, n_dup, n_repeat], features


def base_failed(counts: list[int]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: node i has the children 2i+1 and 2i+2; ``x > cut`` goes right."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth, shrunken log-odds
    start: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Chance of good quality for each row of ``x``; all rows walk a tree level together."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 40, depth: int = 3,
               rate: float = 0.2, bins: int = 48, ridge: float = 5.0) -> Forest:
    """Second-order boosting of the log loss over quantile bins.

    A split on a constrained feature is refused when its two sides would move against the
    direction, and the midpoint of the sides bounds all later leaves below it, so the whole
    forest is monotonic in that feature. One class only, or no rows: no splits are made.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate_good = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(rate_good / (1 - rate_good)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    logit = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for i in range(inner):
            low[2 * i + 1] = low[2 * i + 2] = low[i]
            high[2 * i + 1] = high[2 * i + 2] = high[i]
            here = np.flatnonzero(node == i)
            best = None
            g_all, h_all = grad[here].sum(), hess[here].sum()
            for f, sign in enumerate(directions):
                if not len(cuts[f]) or not len(here):
                    continue
                g = np.cumsum(np.bincount(binned[here, f], grad[here], len(cuts[f]) + 1))[:-1]
                h = np.cumsum(np.bincount(binned[here, f], hess[here], len(cuts[f]) + 1))[:-1]
                left, right = (np.clip(a / (b + ridge), low[i], high[i]) for a, b in ((g, h), (g_all - g, h_all - h)))
                gain = left * g - left**2 * (h + ridge) / 2 + right * (g_all - g) - right**2 * (h_all - h + ridge) / 2
                gain[(h < 1) | (h_all - h < 1) | (sign * (right - left) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, (left[k] + right[k]) / 2)
            whole = np.clip(g_all / (h_all + ridge), low[i], high[i]) if len(here) else 0.0
            if best is not None and best[0] > whole * g_all - whole**2 * (h_all + ridge) / 2 + 1e-9:
                _, f, k, middle = best
                feature[t, i], cut[t, i] = f, cuts[f][k]
                if directions[f] > 0:
                    high[2 * i + 1], low[2 * i + 2] = min(high[i], middle), max(low[i], middle)
                elif directions[f] < 0:
                    low[2 * i + 1], high[2 * i + 2] = max(low[i], middle), min(high[i], middle)
            node[here] = 2 * i + 1 + (x[here, feature[t, i]] > cut[t, i])
        for k in range(leaves):
            here = node == inner + k
            value = grad[here].sum() / (hess[here].sum() + ridge)
            leaf[t, k] = rate * np.clip(value, low[inner + k], high[inner + k])
        logit = logit + leaf[t][node - inner]
    return Forest(feature, cut, leaf, start, depth)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Forest:
    """Fit the forest on at most ``max_rows`` labelled documents.

    The sample is the label rows with the lowest hashes of doc_id; labels without a document, null
    ids and null labels are left out, and a doc_id with several labels takes their lowest. Only the
    ids go out (at most ``max_rows``, hence the broadcast) and only their statistics come back.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
            x = [statistics(t, n)[1] for t, n in zip(as_bytes(b.column("text")), chars)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"])

    got = rows.mapInArrow(of, "doc_id long, quality double, x array<double>").toArrow().to_pandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_forest(x, (got["quality"].to_numpy(float) > 0).astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality_score and kept, in one pass over the texts and without a shuffle.

    Null and empty texts have no words and fail the base rules. Each row is judged by its own text,
    so repeated rows get equal verdicts and an empty table gives an empty result. Input columns that
    bear a result's name are replaced.
    """
    names = [*BASE, "base_failed", "quality_score", "kept"]
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in names]
    return _judged(docs, forest, threshold).select(*kept, "_verdict.*")


def _judged(docs: DataFrame, forest: Forest, threshold: float) -> DataFrame:
    """(_row, _verdict): the input row as a struct, beside its verdict."""

    @F.arrow_udf("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
                 "base_failed:boolean,quality_score:double,kept:boolean>")
    def verdict(text: pa.Array) -> pa.Array:
        chars = pc.fill_null(pc.utf8_length(text), 0).to_pylist()
        counts, x = [], []
        for piece in pieces(text):
            for t in as_bytes(piece):
                c, f = statistics(t, chars[len(counts)])
                counts.append(c)
                x.append(f)
        score = forest.probability(np.array(x, float).reshape(-1, len(FEATURES)))
        failed = np.array([base_failed(c) for c in counts], bool)
        columns = np.array(counts, np.int64).reshape(-1, len(BASE)).T
        return pa.StructArray.from_arrays(
            [*map(pa.array, columns), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
            [*BASE, "base_failed", "quality_score", "kept"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return row.withColumn("_verdict", verdict(F.col("_row")["text"]))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns."""
    return _judged(docs, train(docs, labels), threshold).filter("_verdict.kept").select("_row.*")
