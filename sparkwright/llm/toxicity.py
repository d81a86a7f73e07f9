"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, from document labels.

A sentence's score is a logistic function of its words' weights; a document is toxic if any sentence is, so its
score is 1 - prod(1 - p). The weights are fitted on the driver, with an L1 penalty, to the labels of a bounded
sample of documents (about SAMPLE rows of at most LONGEST code points, by a hash of doc_id); only words and sentence
bounds enter. Sentences of a score below EVIDENCE say nothing and count as 0, so that no text becomes toxic by its
length alone. The sentences whose own score is THRESHOLD or more are the offending ones.

Null and empty texts have no sentences and score 0. Without labels of both kinds every score is 0. Every row is scored by
its own text alone, so repeated rows have equal scores; an empty table gives no rows. The result has columns of its own
only, whatever the table's other columns are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import documents, map_arrow
from sparkwright.llm.quality import labelled_sample

SAMPLE = 8_000
#: Features of the model: in this many sampled documents at least, and so many of the most frequent at most.
LEAST_DOCS, VOCABULARY = 4, 60_000
#: The share of toxic documents among those with a feature, against that of all, from which it may tell anything.
LIFT = 1.5
THRESHOLD = 0.5
#: The least score of a sentence that counts.
EVIDENCE = 0.05
#: The longest documents that a sample may hold, in code points; with its number of rows it bounds the driver's memory.
LONGEST = 50_000

_sentences = re.compile(r"[^.!?\n]+").finditer
_words = re.compile(r"[^\W\d_]+").findall
#: Lengths of word beginnings that are features too, so that compounds of a word share its weight.
PREFIXES = (5, 6, 7)


def terms(sentence: str) -> list[str]:
    """The features of a sentence: its words in lower case, and their beginnings marked with a dash."""
    words = _words(sentence.lower())
    return words + [w[:n] + "-" for w in words for n in PREFIXES if len(w) > n]


@dataclass
class Lexicon:
    """Weights of words and the bias of a sentence."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences whose words are evidence."""
        out, get = [], self.weights.get
        for m in _sentences(text):
            known = [w for w in map(get, terms(m[0])) if w is not None]
            if known:
                p = 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + sum(known)))))
                if p >= EVIDENCE:
                    out.append((m.start(), m.end(), p))
        return out


def score(lexicon: Lexicon, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of a text's sentences, and (start, end, score) of the offending ones."""
    counted = lexicon.sentences(text)
    clean = math.fsum(math.log1p(-min(p, 1 - 1e-15)) for _, _, p in counted)
    return -math.expm1(clean), [x for x in counted if x[2] >= THRESHOLD]


def fit(texts: list[str], y: np.ndarray, *, rounds: int = 120, rate: float = 0.15, penalty: float = 2e-4) -> Lexicon | None:
    """Weights by Adam on the noisy-or's likelihood, shrunk towards zero after each step."""
    if len(y) == 0 or y.min() == y.max():
        return None
    frequency, within = Counter(), Counter()
    for text, label in zip(texts, y, strict=True):
        found = {w for m in _sentences(text) for w in terms(m[0])}
        frequency.update(found)
        if label > 0:
            within.update(found)
    enough = LIFT * y.mean()
    chosen = sorted((-n, w) for w, n in frequency.items() if n >= LEAST_DOCS and within[w] >= enough * n)[:VOCABULARY]
    index = {w: i for i, (_, w) in enumerate(chosen)}
    word, sentence, doc_of = [], [], []
    for d, text in enumerate(texts):
        for m in _sentences(text):
            ids = [index[w] for w in terms(m[0]) if w in index]
            word += ids
            sentence += [len(doc_of)] * len(ids)
            doc_of.append(d)
    word, sentence, doc_of = np.array(word, np.int32), np.array(sentence, np.int32), np.array(doc_of, np.int32)
    del frequency, within
    w, bias = np.zeros(len(index)), -5.0
    m, v, mb, vb = np.zeros(len(index)), np.zeros(len(index)), 0.0, 0.0
    n = len(y)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[word], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        total = np.bincount(doc_of, np.logaddexp(0, z), n)
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
        g = pull[doc_of] * p / n
        gw, gb = np.bincount(word, g[sentence], len(index)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix = rate / (1 - 0.9**t)
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-7
        w -= fix * m / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * penalty / scale)
        bias -= fix * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    keep = np.abs(w) > 0.05
    return Lexicon({word: float(w[i]) for word, i in index.items() if keep[i]}, float(bias))


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, *, label: str = "toxic", bound: int = SAMPLE, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> Lexicon | None:
    """A lexicon fitted to a bounded sample of the labelled documents, none longer than longest, for which allowed (of doc_id) holds."""
    if allowed is not None:
        labels = labels.where(allowed)
    sample = F.broadcast(labelled_sample(labels, label, bound))  # about bound rows of two numbers
    got = documents(docs, id_col, text_col).where(F.length("text") <= longest).join(sample, "doc_id").select("doc_id", "label", "text").toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    return fit(got["text"].tolist(), got["label"].to_numpy(float)) if len(got) else None


def rate(docs: DataFrame, lexicon: Lexicon | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the offending sentences (start, end, score) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon or Lexicon({}, -800.0))  # VOCABULARY words at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [score(model.value, t.as_py()) for t in batch.column(1)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        spans = [[dict(zip(("start", "end", "score"), s, strict=True)) for s in f[1]] for f in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "offending"])

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")
