"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. The longest
previous factor of a suffix, here, is the longest string that it begins with and that starts in such a document too;
in the suffix order it is what the suffix shares with the nearest one of smaller doc_id before it or after it (the
previous and the next smaller position), whichever is longer. A suffix whose factor has LENGTH bytes loses them, so the
first copy stays and later ones go. Orders and factors are taken to LENGTH bytes. The suffix order is built piece by
piece, such that equal strings meet:

1. Of the ANCHOR-byte strings in every window of LENGTH bytes, the one of the smallest hash is the window's anchor;
   equal windows have equal anchors. Anchors of each batch meet in buckets; those of two documents or more are reported
   to their documents, packed for groups of documents of about GROUP bytes of text.
2. Documents with such anchors send the stretch of text whose windows have the anchor to a bucket by the anchor.
   Stretches that are equal within a batch are sent once, for the smallest doc_id, and settled at once for others.
   An anchor of very many documents is hot: its windows go to buckets by their own content instead, one by one. The
   hot anchors are at most HOT_ANCHORS in number, for the threshold grows with the number of all anchors.
3. Each bucket orders its suffixes and takes their factors. Suffixes whose string of LENGTH bytes is alone in the
   bucket, by a hash of it, cannot have such a factor and need no order. The covered stretches are reported to the
   groups of documents and removed.

Null and empty texts have no bytes, an empty table no rows. Rows of equal doc_id are told apart by their texts and do
not remove each other's bytes; repeated rows lose the same. Rows without doc_id keep their bytes and remove none. The
result has columns of its own only, so that other columns of the table may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import Tables, documents, map_batches, map_groups, partitions

LENGTH, ANCHOR = 50, 20
#: Window starts that are looked at together; bytes of text for each bucket of anchors, of stretches and each group of documents.
PIECE, ANCHOR_BUCKET, STRETCH_BUCKET, GROUP = 1 << 19, 16_000_000, 2_000_000, 4_000_000
HOT_ANCHORS, LEAST_HOT = 100_000, 4_000

_LOW = np.uint64((1 << 40) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first window, last window) of each stretch of windows with one anchor.

    data holds the documents' bytes one after another, offsets their bounds; windows do not cross documents.
    """
    out: list[tuple[np.ndarray, ...]] = []
    first, last = int(offsets[0]), int(offsets[-1])
    ends = offsets[1:].astype(np.int64)
    for lo in range(first, last, PIECE):
        hi = min(lo + PIECE, last)
        raw = np.concatenate([data[lo : min(hi + LENGTH, last)], np.zeros(max(0, hi + LENGTH - last) + 8, np.uint8)])
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        grams = hi - lo + LENGTH - ANCHOR
        h = eight[:grams] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = (h + eight[6 : grams + 6]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h = (h + eight[12 : grams + 12]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        key = (h & ~np.uint64(0xFFFFF)) | np.arange(grams, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[:-15], key[15:])[: hi - lo]  # of the LENGTH - ANCHOR + 1 = 31 strings of each window
        at = (key & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.arange(lo, hi)
        doc = np.searchsorted(ends, starts, side="right")
        valid = starts + LENGTH <= ends[doc]
        change = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])]))
        stop = np.append(change[1:], len(starts)) - 1
        good = valid[change]
        change, stop = change[good], stop[good]
        out.append((h[at[change]], doc[change], starts[change], starts[stop]))
    if not out:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values in them."""
    n = len(column)
    _, bounds, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """The starts of runs of equal values, and the end of the last."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])), [len(sorted_values)]])


def _keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((h >> np.uint64(40)) % np.uint64(n_buckets)) << np.uint64(40)) | (h & _LOW)


_ANCHOR_ROWS = "bucket long, low binary, high binary, groups binary, times binary"


def anchor_rows(docs: DataFrame, n_buckets: int, n_groups: int) -> DataFrame:
    """Packed anchors of docs (doc_id, uid, text): for each bucket the keys, the groups that have them and how many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text_bytes(batch.column(2))
            h, doc, _, _ = anchors(data, offsets)
            if not len(h):
                continue
            group = np.mod(batch.column(1).to_numpy(), n_groups)
            key = _keys(h, n_buckets)
            order = np.lexsort((doc, group[doc], key))
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, group = key[new], group[doc[new]]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
            times = np.minimum(np.diff(np.append(first, len(key))), 65535).astype(np.uint16)
            key, group = key[first], group[first].astype(np.uint32)
            edges = _runs(key >> np.uint64(40))
            low, high = key.astype(np.uint32), ((key >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]  # noqa: E731, B023
            buckets = (key[edges[:-1]] >> np.uint64(40)).astype(np.int64)
            columns = [pa.array(buckets), *(pa.array(cut(x), pa.binary()) for x in (low, high, group, times))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ANCHOR_ROWS.split(", ")])

    return map_batches(docs, run, _ANCHOR_ROWS)


#: What groups of documents are told: four packed columns, and a number.
_REPLIES = "group long, part long, a binary, b binary, c binary, d binary"


def _replies(groups: np.ndarray, part: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each run of a group's entries in sorted groups."""
    edges = _runs(groups) if len(groups) else np.zeros(1, np.int64)
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    n = len(edges) - 1
    packed = [cut(x) for x in columns] + [pa.nulls(n, pa.binary())] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(groups[edges[:-1]].astype(np.int64)), pa.array([part] * n, pa.int64()), *packed], ["group", "part", *"abcd"])


def repeated_anchors(rows: DataFrame, hot_at: int, n_parts: int) -> DataFrame:
    """_REPLIES of the keys of a bucket (part) that several documents have, and rows of group -1 of hot ones."""

    def meet(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        unpack = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table[name]), kind)
        k = (unpack("high", np.uint8).astype(np.uint64) << np.uint64(32)) | unpack("low", np.uint32)
        group, times = unpack("groups", np.uint32), unpack("times", np.uint16)
        order = np.argsort(k, kind="stable")
        k, group, times = k[order], group[order], times[order]
        bounds = _runs(k)
        total = np.add.reduceat(times.astype(np.int64), bounds[:-1])
        hot = k[bounds[:-1]][total >= hot_at]
        tell = np.repeat(total > 1, np.diff(bounds))
        k, group = k[tell], group[tell]
        order = np.lexsort((k, group))
        k, group = k[order], group[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (group[1:] != group[:-1])])[: len(k)]
        pack = lambda x: (x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint8))
        yield _replies(group[new], key[0], *pack(k[new]))
        if len(hot):
            yield _replies(np.full(len(hot), -1), key[0], *pack(hot))

    return map_groups(rows, ["bucket"], meet, _REPLIES, n_parts)


def _told_keys(rows: list[tuple]) -> np.ndarray:
    """The sorted keys of replies (part, a, b)."""
    if not rows:
        return np.empty(0, np.uint64)
    unpacked = [(np.uint64(part) << np.uint64(40)) | (np.frombuffer(b, np.uint8).astype(np.uint64) << np.uint64(32)) | np.frombuffer(a, np.uint32) for part, a, b in rows]
    return np.unique(np.concatenate(unpacked))


def answered(docs: DataFrame, replies: DataFrame, prepare, work, schema: str, n_parts: int) -> DataFrame:
    """work(prepare(replies of the group), documents) of documents (doc_id, uid, text) that share a group, batch by batch.

    replies are _REPLIES; prepare gets (part, a, b, c, d) of each. A group's replies come before its documents, which pass in a stream.
    """
    none = F.lit(None)
    told = replies.select("group", "part", F.lit(0).alias("kind"), none.cast("long").alias("doc_id"), none.cast("long").alias("uid"), none.cast("string").alias("text"), *"abcd")
    asked = docs.select("group", none.cast("long").alias("part"), F.lit(1).alias("kind"), "doc_id", "uid", "text", *(none.cast("binary").alias(c) for c in "abcd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            group, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(group):
                continue
            edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if group[x] != now:
                    now, held, ready = group[x], [], None
                part = batch.slice(x, y - x)
                if kind[x] == 0:
                    held += zip(*(part.column(k).to_pylist() for k in (1, 6, 7, 8, 9)), strict=True)
                    continue
                if ready is None:
                    ready, held = prepare(held), []
                yield from work(ready, part.select(["doc_id", "uid", "text"]))

    dealt = told.union(asked).repartition(n_parts, "group").sortWithinPartitions("group", "kind")
    return map_batches(dealt, run, schema)


_STRETCH_ROWS = "bucket long, starts binary, ends binary, bytes binary, lengths binary, ids binary, uids binary"


def stretch_rows(docs: DataFrame, replies: DataFrame, hot_keys: np.ndarray, n_anchor_buckets: int, n_buckets: int, n_groups: int, n_parts: int) -> DataFrame:
    """Packed stretches of docs around repeated anchors, and, in buckets below 0, what a batch settles alone."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot_keys))  # HOT_ANCHORS at most

    def stretches(known: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(known):
            return
        hot = shared.value
        data, offsets = _text_bytes(batch.column(2))
        h, doc, a, b = anchors(data, offsets)
        ids, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key = _keys(h, n_anchor_buckets)
        keep = _isin(key, known)
        if not keep.any():
            return
        key, doc, a, b = key[keep], doc[keep], a[keep], b[keep]
        warm = _isin(key, hot)
        if warm.any():  # one stretch for each window
            times = np.where(warm, b - a + 1, 1)
            at = np.repeat(np.arange(len(key)), times)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            begin = a[at] + inner
            stop = np.where(warm[at], begin, b[at])
            key, doc, a, b, warm = key[at], doc[at], begin, stop, warm[at]
        raw = memoryview(data)
        seen: dict[bytes, list[int]] = {}
        for i, (x, y) in enumerate(zip(a.tolist(), (b + LENGTH).tolist(), strict=True)):
            seen.setdefault(bytes(raw[x:y]), []).append(i)
        start = offsets[doc]
        whose = ids[doc]
        sent: list[int] = []
        settled: list[int] = []
        for places in seen.values():
            if len(places) == 1:
                sent += places
            else:
                least = whose[places].min()
                for i in places:
                    (sent if whose[i] == least else settled).append(i)
        rows = []
        if settled:
            s = np.array(settled)
            group = np.mod(uids[doc[s]], n_groups)
            by = np.argsort(group, kind="stable")
            s, edges = s[by], _runs(group[by])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                part = s[x:y]
                rows.append((-1 - int(group[by[x]]), (a[part] - start[part]).astype(np.int32).tobytes(), (b[part] + LENGTH - start[part]).astype(np.int32).tobytes(), None, None, whose[part].tobytes(), uids[doc[part]].tobytes()))
        s = np.array(sent)
        bucket = ((key[s] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(n_buckets)
        for i in np.flatnonzero(warm[s]).tolist():
            bucket[i] = zlib.crc32(raw[a[s[i]] : a[s[i]] + LENGTH]) % n_buckets
        order = np.argsort(bucket, kind="stable")
        s, bucket = s[order], bucket[order]
        edges = _runs(bucket)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            part = s[x:y]
            content = b"".join([raw[i:j] for i, j in zip(a[part].tolist(), (b[part] + LENGTH).tolist(), strict=True)])
            rows.append((int(bucket[x]), (a[part] - start[part]).astype(np.int32).tobytes(), None, content, (b[part] + LENGTH - a[part]).astype(np.int32).tobytes(), whose[part].tobytes(), uids[doc[part]].tobytes()))
        kinds = [pa.int64()] + [pa.binary()] * 6
        names = [x.split()[0] for x in _STRETCH_ROWS.split(", ")]
        for at in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024], strict=True), kinds, strict=True)], names)

    return answered(docs, replies, lambda rows: _told_keys([r[:3] for r in rows]), stretches, _STRETCH_ROWS, n_parts)


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1.

    Where that is not the place next to it, a tree of the minima of blocks is climbed and descended.
    """
    out = np.arange(-1, len(values) - 1)
    at = 1 + np.flatnonzero(values[:-1] >= values[1:])
    out[at] = -1
    levels = [values]
    while len(levels[-1]) > 1:
        v = levels[-1]
        v = np.append(v, v[-1]) if len(v) % 2 else v
        levels.append(np.minimum(v[::2], v[1::2]))
    who, wanted = at, values[at]
    for k, v in enumerate(levels):
        if not len(who):
            break
        hit = (at % 2 == 1) & (v[np.maximum(at - 1, 0)] < wanted)
        node, below = at[hit] - 1, wanted[hit]
        for lower in reversed(levels[:k]):
            right = np.minimum(2 * node + 1, len(lower) - 1)
            node = np.where(lower[right] < below, right, 2 * node)
        out[who[hit]] = node
        who, at, wanted = who[~hit], at[~hit] // 2, wanted[~hit]
    return out


_OFFSETS = (*range(0, LENGTH - 7, 8), LENGTH - 8)


def agreement(keys: list[np.ndarray], p: np.ndarray | slice, q: np.ndarray | slice) -> np.ndarray:
    """How many bytes strings p and q share from their start, LENGTH at most; keys are their words, one array for each of _OFFSETS."""
    out = np.full(len(keys[0][p]), LENGTH, np.int64)
    for at, key in zip(reversed(_OFFSETS), reversed(keys), strict=True):
        differs = key[p] ^ key[q]
        some = np.flatnonzero(differs)
        d = differs[some]
        out[some] = at + sum((d < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
    return out


def suffix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of strings by their words: by the first one, then, among those still equal, by each further one."""
    order = np.argsort(keys[0])
    new = np.append(True, np.diff(keys[0][order]) != 0)
    for key in keys[1:]:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        some = order[tied]
        word = key[some]
        by_word = np.argsort(word)
        rank = np.empty(len(some), np.int64)
        rank[by_word] = np.cumsum(np.append(False, np.diff(word[by_word]) != 0))
        both = (np.cumsum(new)[tied] << 32) | rank
        place = np.argsort(both)
        order[tied] = some[place]
        new[tied] |= np.append(True, np.diff(both[place]) != 0)
    return order


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTES = np.random.default_rng(20_240_918).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def string_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes at each start: a polynomial modulo 2**64, from running sums."""
    if len(_powers[0]) <= len(data):
        n = max(len(data) + 1, 2 * len(_powers[0]))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64)), dtype=np.uint64) for x in (_BASE, _INVERSE)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers[0][: len(data)], out=sums[1:])
    h = (sums[starts + LENGTH] - sums[starts]) * _powers[1][starts]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each start the length, to LENGTH, of its longest string that starts in a document of a smaller id too.

    Strings that are alone among the starts, by a hash of their LENGTH bytes, have 0.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    out = np.zeros(len(starts), np.int64)
    h = string_hashes(data, starts)
    by_hash = np.argsort(h)
    same = np.diff(h[by_hash]) == 0
    several = np.append(False, same) | np.append(same, False)
    shared = by_hash[several]
    if not len(shared):
        return out
    # equal strings side by side, ties by id; the hash tells them apart from others unless their bytes say otherwise
    new = ~np.append(False, same)[several]
    rank = ids[shared] if 0 <= ids.min() and ids.max() < 1 << 32 else np.unique(ids[shared], return_inverse=True)[1]
    order = shared[np.argsort((np.cumsum(new) << 32) | rank)]
    key = [words[starts[order] + at] for at in _OFFSETS]
    if any((k[1:] != k[:-1])[~new[1:]].any() for k in key):
        order = shared[np.lexsort((ids[shared], *(words[starts[shared] + at].astype(np.uint64) for at in reversed(_OFFSETS))))]
        key = [words[starts[order] + at] for at in _OFFSETS]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    doc = ids[order]
    # within a run of equal strings ids ascend, so all but the smallest have a smaller one before them in the run
    factor = np.where(doc > doc[first][run], LENGTH, 0)
    # the smallest of a run have their smaller neighbours in other runs, whose suffix order is that of their first strings
    keys = [k[first].astype(np.uint64) for k in key]
    suffixes = suffix_order(keys)
    keys, least = [k[suffixes] for k in keys], doc[first][suffixes]
    next_to = np.append(0, agreement(keys, slice(1, None), slice(None, -1)))
    longest = np.zeros(len(first), np.int64)
    for step, neighbour in ((-1, smaller_before(least)), (1, len(least) - 1 - smaller_before(least[::-1])[::-1])):
        has = np.flatnonzero((neighbour >= 0) & (neighbour < len(least)))
        beside = neighbour[has] == has + step
        near, far = has[beside], has[~beside]
        longest[near] = np.maximum(longest[near], next_to[np.maximum(near, near + step)])
        longest[far] = np.maximum(longest[far], agreement(keys, far, neighbour[far]))
    of_run = np.empty(len(first), np.int64)
    of_run[suffixes] = longest
    out[order] = np.maximum(factor, of_run[run])
    return out


def covered(rows: DataFrame, n_groups: int, n_parts: int) -> DataFrame:
    """_REPLIES of the stretches of bytes that go: packed doc_id, uid, start and end of each."""

    def order(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        unpack = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table[name]), kind)
        ids, uids, at = unpack("ids", np.int64), unpack("uids", np.int64), unpack("starts", np.int32).astype(np.int64)
        if key[0] < 0:
            owner, begin, end = np.arange(len(ids)), at, unpack("ends", np.int32).astype(np.int64)
        else:
            data, lengths = unpack("bytes", np.uint8), unpack("lengths", np.int32).astype(np.int64)
            if len(lengths) < 2:
                return
            windows = lengths - LENGTH + 1
            owner = np.repeat(np.arange(len(lengths)), windows)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            gone = longest_previous_factors(data, (np.cumsum(lengths) - lengths)[owner] + inner, ids[owner]) >= LENGTH
            owner, begin = owner[gone], at[owner[gone]] + inner[gone]
            if not len(owner):
                return
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1)]))
            last = np.append(first[1:], len(owner)) - 1
            owner, begin, end = owner[first], begin[first], begin[last] + LENGTH
        group = np.mod(uids[owner], n_groups)
        by = np.lexsort((begin, uids[owner], ids[owner], group))
        yield _replies(group[by], 0, ids[owner][by], uids[owner][by], begin[by].astype(np.int32), end[by].astype(np.int32))

    return map_groups(rows, ["bucket"], order, _REPLIES, n_parts)


def spans_to_remove(docs: DataFrame, tables: Tables, n_groups: int) -> DataFrame:
    """_REPLIES of packed doc_id, uid, start and end of what goes from docs (doc_id, uid, group, text)."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_anchor, n_stretch = max(n_parts, size // ANCHOR_BUCKET), max(n_parts, size // STRETCH_BUCKET)
    hot_at = max(LEAST_HOT, size // 8 // HOT_ANCHORS)  # there are fewer than size / 8 anchors
    found = tables.write(repeated_anchors(anchor_rows(docs.select("doc_id", "uid", "text"), n_anchor, n_groups), hot_at, n_parts), "anchors")
    hot = found.where("group = -1").select("part", "a", "b").collect()
    gone = tables.write(covered(stretch_rows(docs, found.where("group >= 0"), _told_keys([*map(tuple, hot)]), n_anchor, n_stretch, n_groups, n_parts), n_groups, n_parts), "covered")
    tables.keep_only("covered")
    return gone


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of the union of stretches."""
    order = np.argsort(starts, kind="stable")
    a, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    return [*zip(a[first].tolist(), reach[np.append(first[1:], len(a)) - 1].tolist(), strict=True)]


def _told_spans(rows: list[tuple]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Starts and ends by (doc_id, uid)."""
    if not rows:
        return {}
    ids, uids, starts, ends = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int32)))
    order = np.lexsort((uids, ids))
    ids, uids, starts, ends = ids[order], uids[order], starts[order], ends[order]
    edges = np.concatenate([np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (uids[1:] != uids[:-1])])), [len(ids)]])
    return {(int(ids[a]), int(uids[a])): (starts[a:b], ends[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}


_RESULT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def _cut(spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes, found, kept = [], [], []
    for doc_id, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        raw, at, parts = text.as_py().encode(), 0, []
        cut = merge(*spans[doc_id, uid]) if (doc_id, uid) in spans else []
        for a, b in cut:
            parts.append(raw[at:a])
            at = b
        sizes.append(len(raw))
        found.append([{"start": a, "end": b} for a, b in cut])
        kept.append(b"".join([*parts, raw[at:]]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: the removed runs of bytes, and the remaining bytes."""
    spark = docs.sparkSession
    tables, n_parts = Tables(spark, "suffix"), partitions(spark)
    docs = documents(docs, id_col, text_col).withColumn("uid", F.xxhash64("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(n_parts, size // GROUP)
    named = docs.where("doc_id is not null").withColumn("group", F.pmod("uid", F.lit(n_groups)))
    gone = spans_to_remove(named, tables, n_groups)
    cut = answered(named, gone, _told_spans, _cut, _RESULT, n_parts)
    nameless = docs.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return cut.union(nameless)
