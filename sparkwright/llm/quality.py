"""Quality rules: fixed rules and gradient-boosted trees over document statistics.

The trees are fitted on the driver to a bounded sample of labelled documents (SAMPLE rows at most in expectation,
chosen by a hash of doc_id), with monotonic constraints on chosen statistics, and flattened into node arrays of
numpy, over which every document is scored batch by batch. Everything else covers every document whole.

A document fails the rules if it has fewer than MIN_WORDS words, or if over MAX_REPEAT per cent of its words stand
in repeated windows of WINDOW words. It is kept if it passes and the trees give it a score of THRESHOLD or more.
Null and empty texts have no words and fail. Without labels of both kinds there are no trees and the score is 1. Every
row is judged by its own text alone, so repeated rows have equal verdicts; an empty table gives no rows. The result of
assess has columns of its own only, keep returns the table's own columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import WORD, documents, in_sample, map_arrow

SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
THRESHOLD = 0.5
#: Rows of text that are judged before their results go on.
SLICE = 1_000

SYMBOLS = "#*$%&|<>"

_words = re.compile(WORD).findall
_has_word = re.compile(WORD).search

#: Statistics that the trees see, with the direction in which quality may change with each: -1 falls, 0 either.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_rate": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "letter_share": 0,
    "words_a_line": 0,
    "marks_rate": 0,
    "pipe_rate": -1,
    "longest_word": 0,
}

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """The number of words that stand in a window of words which the text has twice or more."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    found, covered, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if found[gram] > 1:
            covered += i + window - max(end, i)
            end = i + window
    return covered


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The counts of STATS and the values of FEATURES of one text."""
    words = _words(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _has_word(x)]
    dup = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    each = max(n, 1)
    upper = sum(w.isupper() for w in words)
    letters = sum(w.isalpha() for w in words)
    marks = text.count(".") + text.count(",") + text.count("!") + text.count("?")
    features = [
        float(np.log1p(n)),
        chars / each,
        symbols / max(chars, 1),
        dup / max(len(lines), 1),
        repeated / each,
        len(set(words)) / each,
        upper / each,
        letters / each,
        n / max(len(lines), 1),
        marks / each,
        text.count("|") / each,
        float(max(map(len, words), default=0)),
    ]
    return (n, chars, symbols, dup, repeated), features


@dataclass
class Trees:
    """Boosted trees as flat node arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality of each row of FEATURES."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], *, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> Trees | None:
    """Boosted trees for 0/1 labels, or None where only one label occurs.

    A split on a constrained feature is allowed only if its sides' values are in the right order, and bounds at
    their middle keep all later splits below it in that order.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_depth: int) -> int:
        me, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        nodes.append([0, 0.0, me, me, value * rate])
        best, choice = 1e-6, None
        if left_depth:
            for k, direction in enumerate(directions):
                size = len(cuts[k]) + 1
                gk = np.cumsum(np.bincount(binned[rows, k], g[rows], size))[:-1]
                hk = np.cumsum(np.bincount(binned[rows, k], h[rows], size))[:-1]
                vl = np.clip(-gk / (hk + ridge), low, high)
                vr = np.clip(-(gs - gk) / (hs - hk + ridge), low, high)
                gain = gk**2 / (hk + ridge) + (gs - gk) ** 2 / (hs - hk + ridge) - gs**2 / (hs + ridge)
                gain[(hk < least) | (hs - hk < least) | (direction * (vr - vl) < 0)] = -1
                if len(gain) and gain.max() > best:
                    b = int(gain.argmax())
                    best, choice = float(gain[b]), (k, b, float(vl[b]), float(vr[b]))
        if choice is None:
            total[rows] += value * rate
            return me
        k, b, vl, vr = choice
        middle, goes = (vl + vr) / 2, binned[rows, k] <= b
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[k]]
        nodes[me][:2] = [k, float(cuts[k][b])]
        nodes[me][2] = grow(rows[goes], g, h, *bounds[0], left_depth - 1)
        nodes[me][3] = grow(rows[~goes], g, h, *bounds[1], left_depth - 1)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -8.0, 8.0, depth))
    f = np.array(nodes)
    return Trees(base, np.array(roots), f[:, 0].astype(int), f[:, 1], f[:, 2].astype(int), f[:, 3].astype(int), f[:, 4], depth)


def labelled_sample(labels: DataFrame, label: str, bound: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of about bound labelled rows, those with the smallest hashes of doc_id; all if fewer."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return rows.where(in_sample(F.col("doc_id"), label, rows.count(), bound))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees fitted to a bounded sample of the labelled documents (see labelled_sample)."""
    sample = F.broadcast(labelled_sample(labels, label, bound))  # about bound rows of two numbers
    rows = documents(docs, id_col, text_col).join(sample, "doc_id").select("doc_id", "label", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [statistics(t.as_py())[1] for t in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = map_arrow(rows, run, "doc_id long, label int, x array<double>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    if got.empty:
        return None
    return fit(np.array(got["x"].tolist()), got["label"].to_numpy(float), [*FEATURES.values()])


def judge(texts: pa.Array, trees: Trees | None) -> dict[str, np.ndarray]:
    """STATS, base_failed, score and kept of a batch of texts."""
    found = [statistics(t.as_py() or "") for t in texts]
    counts = np.array([f[0] for f in found], dtype=np.int64).reshape(-1, len(STATS))
    out = {name: counts[:, k] for k, name in enumerate(STATS)}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * out["n_words"])
    out["score"] = trees.score(np.array([f[1] for f in found])) if trees else np.ones(len(found))
    out["kept"] = ~out["base_failed"] & (out["score"] >= THRESHOLD)
    return out


def assess(docs: DataFrame, trees: Trees | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of STATS, base_failed, score and kept of every document."""
    kinds = {**dict.fromkeys(STATS, "long"), "base_failed": "boolean", "score": "double", "kept": "boolean"}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = judge(batch.column(1), trees)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k]) for k in kinds)], ["doc_id", *kinds])

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in kinds.items()), SLICE)


def keep(docs: DataFrame, trees: Trees | None, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is kept."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge(batch.column(at), trees)["kept"]))

    return map_arrow(docs, run, docs.schema, SLICE)
