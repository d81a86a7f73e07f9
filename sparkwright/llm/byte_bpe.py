"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut into the matches of the tokenizer's pattern. Each distinct match is encoded once per worker by the
tokenizers library, whose byte-level stage maps bytes to characters, and its ids and character offsets are kept in
a bounded table; a text's ids are the concatenation. Decoding reverses the byte table: every id stands for some
bytes, and characters that tokens split between them come together again when the bytes are joined.

Nulls and empty texts have no tokens and decode to nothing. Repeated rows give repeated results, an empty table gives no
rows. The result has columns of its own only, whatever the table's other columns are called.
"""

from __future__ import annotations

import base64
import json
import os
from functools import cached_property, lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from sparkwright.llm.common import documents, map_arrow

#: Distinct pieces of a generation; a worker keeps two, and what is used again moves to the newer one. Pieces over
#: LONG_PIECE characters are not kept.
KEPT_PIECES = 80_000
LONG_PIECE = 64
#: Rows of text that are encoded or decoded before their results go on.
SLICE = 1_000

#: What an id outside the vocabulary decodes to: U+FFFD in UTF-8.
UNKNOWN = b"\xef\xbf\xbd"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte) if byte in plain else chr(spare))
        spare += byte not in plain
    return out


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of two bytes or more, in rank order."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class Codec:
    """Encodes texts to ids and ids to bytes for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
        self._parts = ranks, merges
        self.split = regex.compile(pattern)
        self.table = [UNKNOWN] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.offsets: dict[str, list[tuple[int, int]]] = {}

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's tokenizer; decoding does without."""
        chars = byte_characters()
        spell = lambda token: "".join(chars[b] for b in token)
        ranks, merges = self.__dict__.pop("_parts")  # not needed again
        vocab = {spell(t): r for t, r in ranks.items()}
        out = Tokenizer(models.BPE(vocab=vocab, merges=[(spell(a), spell(b)) for a, b in merges], ignore_merges=True))
        out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return out

    def _learn(self, missing: set[str]) -> None:
        """Keeps the ids of pieces: those of the older generation, and others as the library encodes them."""
        found = {p: ids for p in missing if (ids := self.older.get(p))}
        new = [p for p in missing if p not in found]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            found[p] = np.asarray(e.ids, dtype="<u4").tobytes()
        self.ids.update(found)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.ids) > KEPT_PIECES:
            self.ids, self.older = {}, self.ids
        pieces = self.split.findall(text)
        missing = set(pieces).difference(self.ids)
        if missing:
            self._learn(missing)
        ids = b"".join(map(self.ids.__getitem__, pieces))
        for p in missing:
            if len(p) > LONG_PIECE:
                del self.ids[p]
        return ids

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The characters [start, end) that each id comes from; ids that share a character share its span."""
        out: list[tuple[int, int]] = []
        for match in self.split.finditer(text):
            piece, at = match[0], match.start()
            if piece not in self.offsets:
                if len(self.offsets) > KEPT_PIECES:
                    self.offsets.clear()
                self.offsets[piece] = self.tokenizer.encode(piece, add_special_tokens=False).offsets
            out += ((at + a, at + b) for a, b in self.offsets[piece])
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if len(numbers) and int(numbers.max()) >= len(self.table):
            return b"".join(self.table[i] if i < len(self.table) else UNKNOWN for i in numbers.tolist())
        return b"".join(map(self.table.__getitem__, numbers.tolist()))


@lru_cache(2)
def _codec(spec: bytes) -> Codec:
    x = json.loads(spec)
    ranks = {base64.b64decode(t): r for r, t in x["tokens"]}
    merges = [(base64.b64decode(a), base64.b64decode(b)) for a, b in x["merges"]]
    return Codec(ranks, merges, x["pattern"])


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> bytes:
    """A vocabulary with its merges, ready to be sent to workers; its size is fixed by the file at path."""
    ranks = read_ranks(path)
    code = lambda token: base64.b64encode(token).decode()
    tokens = [(r, code(t)) for t, r in ranks.items()]
    merges = [(code(a), code(b)) for a, b in merges_of(ranks)]
    return json.dumps({"tokens": tokens, "merges": merges, "pattern": pattern}).encode()


def encode(docs: DataFrame, path: str, pattern: str, *, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary[, starts, ends]) of every whole text.

    ids holds little-endian unsigned 32-bit integers; starts and ends are character offsets of each id, end
    exclusive. The vocabulary is broadcast: its size is that of the file at path, whatever the input.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    fields = ", starts array<int>, ends array<int>" if offsets else ""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(spec.value)
        texts = batch.column(1)
        ids = [codec.encode(t.as_py()) for t in texts]
        columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        names = ["doc_id", "n_tokens", "ids"]
        if offsets:
            spans = [codec.spans(t.as_py()) for t in texts]
            columns += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            names += ["starts", "ends"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(documents(docs, id_col, text_col), run, f"doc_id long, n_tokens long, ids binary{fields}", SLICE)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns doc_id, n_tokens, ids of encode() and decoded binary: the bytes that the ids stand for.

    Null ids decode to no bytes; an id outside the vocabulary decodes to U+FFFD.
    """
    spec = encoded.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(spec.value)
        decoded = [codec.decode(x.as_py() or b"") for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return map_arrow(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, decoded binary", SLICE)


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What decode() gives for encode(): (doc_id, n_tokens, ids, decoded), in one pass over the texts."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(spec.value)
        ids = [codec.encode(t.as_py()) for t in batch.column(1)]
        decoded = [codec.decode(x) for x in ids]
        columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary, decoded binary", SLICE)
