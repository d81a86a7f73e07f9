"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The field's nodes are the tokens that may be part of such data at all, those with a digit, an @ or a written-out at in
brackets, wherever they stand; the words beside them enter as context. Neighbouring nodes share chain potentials, and
equal or similar tokens at any distance in a document (the same last digits, the same address however it writes its at)
share skip potentials, each with its next occurrence, so that what is plainly personal data in one place decides the
label of its other mentions. What the fixed patterns find is given. Loopy message passing over the whole batch's graph at once gives each token's
probabilities, and runs of tokens of one kind at CONFIDENT or more become spans where no fixed pattern has one.

Weights are fitted by pseudo-likelihood on the driver in about SAMPLE documents of at most LONGEST code points, chosen by
a hash of doc_id. Labels are the fixed patterns' spans, and mentions that are planted in the sampled texts: found
entities in forms that no pattern finds, and numbers of the same forms that are no entity of the document, which are
outside. Tokens that repeat a found entity by themselves are left out.

Null and empty texts have no spans. Patterns and tokens take time linear in the text. Every row is read on its own, so
repeated rows have equal spans; an empty table gives no rows. The result has columns of its own only, whatever the
table's other columns are called.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import documents, in_sample, map_arrow

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4_000
#: The longest documents that a sample may hold, in code points; with its number of rows it bounds the driver's memory.
LONGEST = 50_000
CONFIDENT = 0.7
PASSES, DAMPING = 12, 0.5
#: What a given label adds to its log potential.
SURE = 50.0

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can start inside a run of digits only where it can start at the run's first digit, so only that is tried
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]")
_token = re.compile(r"(?<![^\x20\x09-\x0D])(?:(?![\[(]at[\])])[^\x20\x09-\x0D0-9@])*+(?:[0-9@]|[\[(]at[\])])[^\x20\x09-\x0D]*+")
_at, _dot = re.compile(r"\[at\]|\(at\)"), re.compile(r"\[(?:dot|\.)\]|\((?:dot|\.)\)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        end = at + 1
        if start < at and (m := _domain.match(text, at + 1)):
            end = free = m.end()
            out.append((start, end))
        else:
            free = max(free, at + 1)
        at = text.find("@", end)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    return [m.span() for m in _ip.finditer(text) if all(map(small, m[0].split(".")))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _card.finditer(text):
        if 13 <= len(m[0]):
            digits = "".join(_digits.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _phone.finditer(text) if 9 <= len(_digits.findall(m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    found = zip(KINDS, (_emails, _ips, _cards, _phones), strict=True)
    return [(kind, a, b) for kind, find in found for a, b in find(text)]


def tokens(text: str) -> list[tuple[int, int]]:
    """The spans of the field's nodes, without outer punctuation."""
    out = []
    for m in _token.finditer(text):
        a, b = m.span()
        while a < b and not (text[a].isalnum() or text[a] in "_+(@["):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] in "_)"):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


#: Classes that the words beside a node fall into, by a checksum.
CONTEXTS = 24

#: The names of a node's features, in order.
FEATURES = (
    "bias", "at", "plus", "paren", "dot_1", "dot_2", "dot_3", "dot_more", "dash_0", "dash_1", "dash_more", "colon", "slash", "letters", "hex",
    "digits_0", "digits_1", "digits_2", "digits_3", "digits_4", "digits_5_6", "digits_7_8", "digits_9_12", "digits_13_19", "digits_more",
    "before_number", "after_number", "before_plus", "domain", "all_digits", "luhn", "small_parts", "at_word", "dot_word", "luhn_parts",
    *(f"{side}_{k}" for side in ("word_before", "word_after") for k in range(CONTEXTS)),
)
_INDEX = {name: i for i, name in enumerate(FEATURES)}


def _context(text: str, a: int, b: int) -> list[str]:
    """The classes of the words before and after a token, by their last and first 20 code points."""
    before, after = text[max(0, a - 21) : a].split(), text[b : b + 21].split()
    return [f"{side}_{zlib.crc32(w[0].strip('.,:;').lower().encode('utf-8', 'surrogatepass')) % CONTEXTS}" for side, w in (("word_before", before[-1:]), ("word_after", after[:1])) if w]


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """One row of FEATURES for each node of a text."""
    out = np.zeros((len(spans), len(FEATURES)))
    for i, (a, b) in enumerate(spans):
        t = text[a:b]
        digits = "".join(_digits.findall(t))
        n = len(digits)
        dots, dashes = t.count("."), t.count("-")
        on = {"bias"}
        on |= {name for name, c in (("at", "@"), ("colon", ":"), ("slash", "/")) if c in t}
        if t[0] == "+":
            on.add("plus")
        if "(" in t or ")" in t:
            on.add("paren")
        if dots:
            on.add(f"dot_{dots}" if dots <= 3 else "dot_more")
        on.add(f"dash_{dashes}" if dashes <= 1 else "dash_more")
        letters = sum(c.isalpha() for c in t)
        if letters:
            on.add("letters")
        if letters and n > 2 and all(c in "0123456789abcdefABCDEF" for c in t):
            on.add("hex")
        on.add(next((f"digits_{lo}" if lo == hi else f"digits_{lo}_{hi}" for lo, hi in ((0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 6), (7, 8), (9, 12), (13, 19)) if lo <= n <= hi), "digits_more"))
        if i and a - spans[i - 1][1] <= 1:
            on.add("after_number")
            if text[spans[i - 1][0]] == "+":
                on.add("before_plus")
        if i + 1 < len(spans) and spans[i + 1][0] - b <= 1:
            on.add("before_number")
        if "@" in t and "." in t[t.find("@") :]:
            on.add("domain")
        if n == len(t):
            on.add("all_digits")
            if 13 <= n <= 19 and luhn(t):
                on.add("luhn")
        if dots == 3 and n + 3 == len(t) and all(p and len(p) <= 3 and int(p) <= 255 for p in t.split(".")):
            on.add("small_parts")
        if _at.search(t):
            on.add("at_word")
        if _dot.search(t):
            on.add("dot_word")
        if 13 <= n <= 19 and n != len(t) and luhn(digits):
            on.add("luhn_parts")
        on.update(_context(text, a, b))
        out[i, [_INDEX[f] for f in on]] = 1
    return out


def edges(text: str, spans: list[tuple[int, int]], hidden: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between nodes next to each other, and skip edges from each token to its next like one, past hidden ones."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 1]
    last: dict[str, int] = {}
    skip = []
    for i, key in enumerate(keys(text, spans)):
        if ("@" in key or len(key) >= 4) and (hidden is None or not hidden[i]):
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


def keys(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """What tokens that are alike share: the address, however it writes its at and dots, or the last seven digits.

    A token of fewer than four digits is alike only together with the number right after it.
    """
    out: list[str] = []
    for i in range(len(spans) - 1, -1, -1):
        a, b = spans[i]
        t = text[a:b]
        if "@" in t or _at.search(t):
            out.append(_dot.sub(".", _at.sub("@", t)).lower())
            continue
        digits = "".join(_digits.findall(t))[-7:]
        more = len(digits) < 4 and out and spans[i + 1][0] - b <= 1 and len(out[-1]) < 20
        out.append(f"{digits} {out[-1]}" if more else digits)
    return out[::-1]


def unknown(text: str, spans: list[tuple[int, int]], label: np.ndarray) -> np.ndarray:
    """Which tokens without a label repeat one that has a label, or stand beside such a repeat as in the original.

    The fixed patterns say nothing about these: they may be the same entity without its sign.
    """
    key, out = keys(text, spans), np.zeros(len(spans), bool)
    known: dict[str, int] = {}
    for i in np.flatnonzero(label).tolist():
        if "@" in key[i] or len(key[i]) >= 4:
            known.setdefault(key[i], i)
    near = [b[0] - a[1] <= 1 for a, b in zip(spans, spans[1:], strict=False)]
    for i in np.flatnonzero(label == 0).tolist():
        if (j := known.get(key[i])) is None:
            continue
        out[i] = True
        for step in (-1, 1):
            p, q = i + step, j + step
            while 0 <= p < len(spans) and 0 <= q < len(spans) and not out[p] and not label[p] and label[q] == label[j] and key[p] == key[q] and near[min(p, p - step)] and near[min(q, q - step)]:
                out[p] = True
                p, q = p + step, q + step
    return out


def planted(text: str, base: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str | None, int, int]]]:
    """text with more mentions at its end, and their (kind, start, end): None for numbers that are no entity of it.

    Each entity comes again in a form that no fixed pattern finds, and next to numbers of that form with other digits.
    """
    rng, marks = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))), []
    fill = lambda: " ".join(rng.choices("later again see also the other one in and it was so then for a with no more".split(), k=rng.randint(1, 3)))
    for kind, a, b in base:
        form = altered(kind, text[a:b], rng)
        if form is None or rng.random() < 0.3:
            continue
        mentions = [(kind, form)]
        if kind != "email":
            mentions += [(None, re.sub("[0-9]", lambda _: str(rng.randint(0, 9)), form)) for _ in range(rng.randint(1, 2))]
        rng.shuffle(mentions)
        for label, mention in mentions:
            text += f" {fill()} "
            marks.append((label, len(text), len(text) + len(mention)))
            text += mention + rng.choice(("", ".", ","))
    return text, marks


def altered(kind: str, entity: str, rng: random.Random) -> str | None:
    """An entity in a form that no fixed pattern finds: without its sign, or with other marks between its parts."""
    digits = "".join(_digits.findall(entity))
    if kind == "email":
        return entity.replace("@", rng.choice(("[at]", "(at)"))).replace(".", rng.choice((".", "[dot]")))
    if kind == "ip":
        return entity.replace(".", "[.]")
    if kind == "card":
        mark = rng.choice("./")
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    keep = 10 if len(digits) > 10 else len(digits) - 1
    places = [i for i, c in enumerate(entity) if c in "0123456789"]
    at = places[len(places) - keep]
    return entity[at - 1 :] if entity[at - 1] == "(" else entity[at:]


@dataclass
class Field:
    """Weights: of features by label, of chain edges by both labels, of skip edges' agreement by label."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Each node's label probabilities, by loopy sum-product with damping; labels of known, where not 0, are given."""
        n, labels = len(x), len(KINDS) + 1
        own = x @ self.node
        if known is not None:
            given = np.flatnonzero(known)
            own[given, known[given]] += SURE
        if not len(chain) and not len(skip):
            return _softmax(own)
        ends = np.concatenate([chain, skip]).astype(int)
        table = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(np.diag(self.skip)[None], len(skip), 0)])
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        message = np.zeros((len(source), labels))
        for _ in range(PASSES):
            belief = own.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + table
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = own.copy()
        np.add.at(belief, target, message)
        assert len(belief) == n
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def overlapping(spans: list[tuple[int, int]], a: int, b: int) -> list[int]:
    """The places of the spans, which are in order and apart, that overlap a:b."""
    out, i = [], bisect_right(spans, a, key=lambda s: s[1])
    while i < len(spans) and spans[i][0] < b:
        out.append(i)
        i += 1
    return out


def labelled(spans: list[tuple[int, int]], found: list[tuple[str, int, int]]) -> np.ndarray:
    """The kind of each node, from 1, that a found span overlaps; else 0."""
    label = np.zeros(len(spans), int)
    for kind, a, b in found:
        label[overlapping(spans, a, b)] = KINDS.index(kind) + 1
    return label


def fit(texts: list[str], *, plant: bool = True, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> Field | None:
    """Weights by pseudo-likelihood: each node's label given its neighbours' labels from the fixed patterns and planted mentions.

    Unlabelled nodes are neither fitted nor anyone's evidence.
    """
    xs, ys, free, chains, skips, at = [], [], [], [], [], 0
    for text in texts:
        text, marks = planted(text, base_spans(text)) if plant else (text, [])
        spans, base = tokens(text), base_spans(text)
        if not spans:
            continue
        label = labelled(spans, base)
        hidden = unknown(text, spans, label)
        for kind, a, b in marks:
            some = [i for i in overlapping(spans, a, b) if label[i] == 0]
            label[some], hidden[some] = (KINDS.index(kind) + 1 if kind else 0), False
        chain, skip = edges(text, spans, hidden)
        xs.append(features(text, spans))
        ys.append(label)
        free.append(hidden)
        chains += [(a + at, b + at) for a, b in chain]
        skips += [(a + at, b + at) for a, b in skip]
        at += len(spans)
    if not xs:
        return None
    x, y, labels = np.concatenate(xs), np.concatenate(ys), len(KINDS) + 1
    given = ~np.concatenate(free)
    hot = np.eye(labels)[y] * given[:, None]
    left, right, alike = (np.zeros((len(y), labels)) for _ in range(3))
    for a, b in chains:
        left[b] += hot[a]
        right[a] += hot[b]
    for a, b in skips:
        alike[a] += hot[b]
        alike[b] += hot[a]
    params = [np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), np.zeros(labels)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        node, chain_w, skip_w = params
        p = _softmax(x @ node + left @ chain_w + right @ chain_w.T + alike * skip_w)
        d = (p - hot) * given[:, None] / max(1, given.sum())
        grads = [x.T @ d, left.T @ d + d.T @ right, (alike * d).sum(0)]
        for k, g in enumerate(grads):
            g = g + ridge * params[k] / 10
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    params[2] = np.maximum(params[2], 0)  # alike tokens never repel
    return Field(*params)


def train(docs: DataFrame, *, bound: int = SAMPLE, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field fitted to the fixed patterns in about bound documents of at most longest code points that have a digit or an @."""
    rows = documents(docs, id_col, text_col)
    rows = rows.where(in_sample(F.col("doc_id"), "pii", docs.count(), bound) & (F.length("text") <= longest))
    texts = rows.where(F.col("text").rlike("[0-9@]")).toPandas().sort_values(["doc_id", "text"], kind="stable")["text"].tolist()
    return fit(texts)


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], field: Field | None) -> list[list[tuple[str, int, int]]]:
    """What the field finds beside the fixed patterns' spans of each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if field is None:
        return out
    all_spans, xs, given, chains, skips, at = [], [], [], [], [], 0
    for text, base in zip(texts, bases, strict=True):
        spans = tokens(text)
        all_spans.append(spans)
        if spans:
            given.append(labelled(spans, base))
            xs.append(features(text, spans))
            chain, skip = edges(text, spans)
            chains += [(a + at, b + at) for a, b in chain]
            skips += [(a + at, b + at) for a, b in skip]
            at += len(spans)
    if not xs:
        return out
    pairs = lambda e: np.array(e, dtype=int).reshape(-1, 2)
    p = field.marginals(np.concatenate(xs), pairs(chains), pairs(skips), np.concatenate(given))
    best, sure = p.argmax(1), p.max(1) >= CONFIDENT
    at = 0
    for found, spans, base in zip(out, all_spans, bases, strict=True):
        run: list | None = None
        for i, (a, b) in enumerate(spans):
            k = int(best[at + i]) if sure[at + i] else 0
            if k and run and run[0] == KINDS[k - 1] and a - run[2] <= 1:
                run[2] = b
            else:
                if run:
                    found.append(tuple(run))
                run = [KINDS[k - 1], a, b] if k else None
        if run:
            found.append(tuple(run))
        found[:] = [s for s in found if not any(s[1] < b and a < s[2] for _, a, b in base)]
        at += len(spans)
    return out


def find(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, whether a fixed pattern's) of every whole text, in code points."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        bases = [base_spans(t) for t in texts]
        more = added_spans(texts, bases, field)
        order = lambda s: (KINDS.index(s[0]), s[1], s[2])
        spans = [sorted([(*s, True) for s in b] + [(*s, False) for s in m], key=order) for b, m in zip(bases, more, strict=True)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
