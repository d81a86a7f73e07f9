"""Line dedup by a segment-partition edit join.

Two lines are linked if at most EDITS insertions, deletions or substitutions of code points turn one into the other.
Every distinct line of at least LEAST_CHARS code points is cut into EDITS + 1 segments; of two linked lines the longer
has one of the shorter's segments at a place that depends on the lengths, so each line probes, for every length it
may be linked with, the few substrings that can match (multi-match-aware positions). Keys that meet another line's
make candidates, each of them looked at in the first key that its lines share, and a banded bit-parallel edit
distance over many pairs at once decides. A key of very many lines is cut into pairs of blocks; none is capped, and
only a spanning forest of a cell's links and each line's number of links leave it.

Keys are hashes of substrings, taken for all lines of a slice at once from running sums, and travel packed by bucket;
a bucket that a key overfills passes that key's lines on at once, so its memory is bounded.

Linked lines and equal lines are a class. Of each class the first line stays, by doc_id, then row, then place; the
others go. Shorter lines have no links; those of at least EQUAL code points go by equality alone, and the rest always
stay, as empty lines do. Distinct lines go by 128-bit digests of their bytes; the 60-bit hashes that find candidates
decide nothing. Null and empty texts have one empty line; an empty table gives no rows.

Rows of equal doc_id are told apart by their texts; rows without doc_id come after all others. Of rows that are equal
in doc_id and text one, undefined which, is the first: the others lose every line that can go. All columns of the table
come back, but for those that have the names of the result's own, which take their place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.llm.common import Tables, apart, map_batches, partitions
from sparkwright.llm.graph import components, forest_of_pairs

EDITS, LEAST_CHARS, EQUAL = 2, 20, 1
#: Lines of a block; pairs that are verified together; code points of their padded matrix.
BLOCK, PAIRS, CELLS = 512, 8192, 4_000_000
#: Code points whose keys are made together; bytes of text for each bucket of keys; keys of a bucket in memory.
SLICE, KEY_BUCKET, KEYS_HELD = 1_000_000, 8_000_000, 6_000_000
#: Distinct lines whose contents may be looked up by broadcast (24 bytes each); lines that count as very frequent, at most.
FEW_LINES, HOT_LINES = 1_000_000, 10_000
#: Bits of a reference to a line that say which of its segments a key is; 0 for none.
OWN_BITS = 4


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 segments of a line, the longer ones last."""
    n = edits + 1
    small, more = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = small + (i >= n - more)
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(shorter length, segment, start, size) of the substrings of a line that may be a segment of one not longer."""
    out = []
    for delta in range(edits + 1):
        for i, (p, size) in enumerate(segments(length - delta, edits)):
            low = max(0, p - i, p + delta - (edits - i))
            high = min(length - size, p + i, p + delta + (edits - i))
            out += [(length - delta, i, at, size) for at in range(low, high + 1)]
    return out


class Shared:
    """Finds the first key that two lines share; remembers where the substrings of each length lie."""

    def __init__(self, edits: int):
        self.edits, self.places, self.cuts = edits, {}, {}

    def of(self, short: int, length: int) -> list[tuple[int, int, int, int]]:
        """(segment, its start, probe's start, size) for a line of length that probes the segments of one of length short."""
        if (short, length) not in self.places:
            cut = segments(short, self.edits)
            self.places[short, length] = [(i, cut[i][0], at, size) for n, i, at, size in probes(length, self.edits) if n == short]
        return self.places[short, length]

    def one_way(self, short: str, long: str) -> tuple[int, str] | None:
        """(segment, content) of the first segment of the first that the second, not shorter, has at a probed place."""
        for i, p, at, size in self.of(len(short), len(long)):
            if long[at : at + size] == short[p : p + size]:
                return i, short[p : p + size]
        return None

    def first(self, a: str, b: str) -> tuple[int, int, str] | None:
        """(length, segment, content) of the first key that two lines share; of equally long ones either may probe."""
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        found = self.one_way(short, long) or (self.one_way(long, short) if len(a) == len(b) else None)
        return (len(short), *found) if found else None

    def segment(self, line: str, i: int) -> tuple[int, int, str]:
        """The same of a line's own segment."""
        if len(line) not in self.cuts:
            self.cuts[len(line)] = segments(len(line), self.edits)
        p, size = self.cuts[len(line)][i]
        return len(line), i, line[p : p + size]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def line_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, own) of lines: keys of all probed substrings; own is 1 and more for a segment of the line, else 0.

    The hash of a substring is a polynomial over its code points, modulo 2**64, from running sums over all lines.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(_powers[0]) <= len(codes):
        n = max(len(codes) + 1, 2 * len(_powers[0]))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64)), dtype=np.uint64) for x in (_ODD, _INVERSE)]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_scramble(codes.astype(np.uint64) + _ODD) * _powers[0][: len(codes)], out=sums[1:])
    n = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(n) - n
    parts, keys, owners, owns = edits + 1, [], [], []
    for delta in range(parts):
        short = n - delta
        small, more = np.divmod(short, parts)
        for i in range(parts):
            size, p = small + (i >= parts - more), small * i + np.maximum(0, i - (parts - more))
            low = np.maximum(np.maximum(0, p - i), p + delta - (edits - i))
            high = np.minimum(np.minimum(n - size, p + i), p + delta + (edits - i))
            seed = (short * parts + i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for step in range(2 * edits + 1):
                some = np.flatnonzero(low + step <= high)
                if not len(some):
                    break
                at = low[some] + step
                x = start[some] + at
                keys.append(_scramble((sums[x + size[some]] - sums[x]) * _powers[1][x] + seed[some]))
                owners.append(some)
                owns.append(np.where(at == p[some], i + 1, 0) if delta == 0 else np.zeros(len(some), np.int64))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(owns)


def line_ref(line: Column) -> Column:
    """The hash by which candidates are found, as in key_rows."""
    return F.shiftrightunsigned(F.xxhash64(line), OWN_BITS)


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line))


def edit_distance_at_most(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether each pair's edit distance is at most edits: a band of 2 * edits + 1 bits moves down the diagonal."""
    out = np.zeros(len(pairs), bool)
    trimmed = []
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > edits:
            continue
        if len(a) > len(b):
            a, b = b, a
        n = len(a)
        lo = _common(a, b, n)
        hi = _common(a[lo:][::-1], b[lo:][::-1], n - lo)
        trimmed.append((n - lo - hi, i, a[lo : n - hi], b[lo : len(b) - hi]))
    trimmed.sort(key=lambda x: x[0])
    at = 0
    while at < len(trimmed):
        size = max(1, min(PAIRS, CELLS // (trimmed[min(at + PAIRS, len(trimmed)) - 1][0] + 4 * edits + 4)))
        part = trimmed[at : at + size]
        at += size
        out[[x[1] for x in part]] = _banded([x[2] for x in part], [x[3] for x in part], edits)
    return out


def _common(a: str, b: str, n: int) -> int:
    """The length of the common prefix of a and b, n at most, by halving."""
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _matrix(texts: list[str], width: int, before: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.uint32)
    for row, text in zip(out, texts, strict=True):
        row[before : before + len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return out


def _banded(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether the distances of a (not longer) and b are at most edits."""
    end = "\0" * (edits + 1)  # an equal ending leaves distances as they are and makes lines long enough for the band
    a, b = [x + end for x in a], [x + end for x in b]
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band = 2 * edits + 1
    rows, columns = _matrix(a, int(n.max()) + band + 1, edits, 0xFFFFFFFF), _matrix(b, int(n.max()), 0, 0xFFFFFFFE)
    full, top = np.int64((1 << band) - 1), np.int64(1 << (band - 1))
    plus, minus = np.full(len(a), full & ~np.int64((1 << edits) - 1)), np.zeros(len(a), np.int64)
    distance, turn = np.full(len(a), edits), m - edits
    for j in range(int(n.max())):
        live = j < n
        match = np.zeros(len(a), np.int64)
        for k in range(band):
            match |= (rows[:, j + k] == columns[:, j]).astype(np.int64) << k
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up = (minus | ~(diagonal | plus)) & full
        down = diagonal & plus
        sloping = j < turn
        bit = top >> np.clip(j - turn + 1, 0, band)
        step = np.where(sloping, (diagonal & top) == 0, ((up & bit) != 0).astype(np.int64) - ((down & bit) != 0))
        distance = distance + np.where(live, step, 0)
        shifted = diagonal >> 1
        plus, minus = (down | ~(shifted | up)) & full, shifted & up
    return distance <= edits


_KEY_ROWS = "bucket long, low binary, high binary, refs binary"


def key_rows(docs: DataFrame, edits: int, least: int, n_buckets: int) -> DataFrame:
    """Packed keys of the lines of docs (text), equal lines of a batch once: 40 bits of each, and its line's hash with own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()  # lines of the batch, by hash
            lines, refs, size = [], [], 0
            for at, text in enumerate(batch.column(0)):
                for line in text.as_py().split("\n"):
                    if len(line) >= least and (ref := xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42) >> OWN_BITS) not in seen:
                        seen.add(ref)
                        lines.append(line)
                        refs.append(ref)
                        size += len(line)
                        if size >= SLICE:
                            yield packed(lines, refs)
                            lines, refs, size = [], [], 0
                if at == batch.num_rows - 1 and lines:
                    yield packed(lines, refs)

    def packed(lines: list[str], refs: list[int]) -> pa.RecordBatch:
        key, line, own = line_keys(lines, edits)
        key = ((key >> np.uint64(40)) % np.uint64(n_buckets) << np.uint64(40)) | (key & np.uint64((1 << 40) - 1))
        order = np.argsort(key >> np.uint64(40), kind="stable")
        key, ref = key[order], ((np.array(refs, np.uint64) << np.uint64(OWN_BITS))[line] | own.astype(np.uint64))[order]
        bucket = (key >> np.uint64(40)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        columns = (key.astype(np.uint32), ((key >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8), ref)
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), *map(cut, columns)], ["bucket", "low", "high", "refs"])

    return map_batches(docs.select("text"), run, _KEY_ROWS)


def shared_keys(rows: DataFrame, n_parts: int) -> DataFrame:
    """(key, ref, own, hot) of lines whose key another line has too, one of them as its segment.

    Of a key that overfills its bucket (hot) rows can come twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, hot = None, [], 0, np.empty(0, np.uint64)

        def out(key: np.ndarray, ref: np.ndarray, is_hot: bool) -> Iterator[pa.RecordBatch]:
            full, line, own = key | (np.uint64(now) << np.uint64(40)), ref >> np.uint64(OWN_BITS), ref & np.uint64((1 << OWN_BITS) - 1)
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(full[part].view(np.int64)), pa.array(line[part].view(np.int64)), pa.array(own[part].astype(np.int32)), pa.array([is_hot] * len(full[part]))], ["key", "ref", "own", "hot"])

        def compact() -> tuple[np.ndarray, np.ndarray]:
            """Keys and references in order, those of a line and key once, as a segment if they are one."""
            key, ref = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.lexsort((ref, key))
            key, ref = key[order], ref[order]
            last = np.append((key[1:] != key[:-1]) | (ref[1:] >> np.uint64(OWN_BITS) != ref[:-1] >> np.uint64(OWN_BITS)), True)
            return key[last], ref[last]

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                key, ref = compact()
                edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
                own = np.maximum.reduceat(ref & np.uint64((1 << OWN_BITS) - 1), edges[:-1])
                good = np.repeat((np.diff(edges) > 1) & (own > 0), np.diff(edges))
                yield from out(key[good], ref[good], False)

        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now:
                    yield from finish()
                    now, held, size, hot = bucket, [], 0, np.empty(0, np.uint64)
                low, high, ref = (np.frombuffer(x, kind) for x, kind in zip(blobs, (np.uint32, np.uint8, np.uint64), strict=True))
                key = (high.astype(np.uint64) << np.uint64(32)) | low
                if len(hot) and (known := np.isin(key, hot)).any():
                    yield from out(key[known], ref[known], True)
                    key, ref = key[~known], ref[~known]
                held.append((key, ref))
                size += len(key)
                if size > KEYS_HELD:
                    key, ref = compact()
                    many, times = np.unique(key, return_counts=True)
                    many = many[times > max(2, KEYS_HELD // 64)]
                    known = np.isin(key, many)
                    yield from out(key[known], ref[known], True)
                    hot = np.union1d(hot, many)
                    held = [(key[~known], ref[~known])]
                    size = len(held[0][0])
        yield from finish()

    dealt = rows.repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, run, "key long, ref long, own int, hot boolean")


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(line, doc_id, uid, place) of every line of docs (doc_id, uid, text) that is long enough."""
    lines = docs.select("doc_id", "uid", F.posexplode(F.split("text", "\n", -1)).alias("place", "content"))
    return lines.where(F.length("content") >= least).select(line_id(F.col("content")).alias("line"), "doc_id", "uid", "place")


def texts_of(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(ref, line, content) of the wanted lines (ref), once each; few of them, by count, are sent to the texts."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("content")).where(F.length("content") >= least)
    few = wanted.count() <= FEW_LINES
    found = lines.select(line_ref(F.col("content")).alias("ref"), "content").join(F.broadcast(wanted) if few else wanted, "ref", "left_semi")
    return found.groupBy("ref", line_id(F.col("content")).alias("line")).agg(F.first("content").alias("content"))


def links(cells: DataFrame, edits: int, n_parts: int) -> DataFrame:
    """(a, b, n): forest edges of each cell's links, and with null b the number n of links that it adds to line a.

    cells: key, low, high, block, line, own, content; the rows of (key, low, high) are a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Shared(edits)
        held: list[tuple[bytes, bytes, str, str]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                good = np.flatnonzero(edit_distance_at_most([(x[2], x[3]) for x in held], edits)).tolist()
                pairs = [held[k][:2] for k in good]
                held.clear()
                if pairs:
                    times = Counter(x for pair in pairs for x in pair)
                    tree = forest_of_pairs(pairs)
                    columns = [*(t[0] for t in tree), *times], [*(t[1] for t in tree), *[None] * len(times)], [*[0] * len(tree), *times.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "n"])

        def pairs(one_block: bool, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                if not r[2]:
                    continue
                key = shared.segment(r[3], r[2] - 1)
                for s in rows:
                    if s[1] == r[1] or (not one_block and s[0] == r[0]) or (s[2] and s[1] < r[1]) or abs(len(r[3]) - len(s[3])) > edits:
                        continue
                    if shared.first(*((r[3], s[3]) if r[1] < s[1] else (s[3], r[3]))) == key:
                        held.append((r[1], s[1], r[3], s[3]))
                if len(held) >= PAIRS:
                    yield from flush()

        now: tuple | None = None
        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for k, low, high, block, line, own, content in zip(*columns, strict=True):
                if (k, low, high) != now:
                    if len(rows) > 1:
                        yield from pairs(now[1] == now[2], rows)
                    now, rows = (k, low, high), []
                rows.append((block, line, own, content))
        if len(rows) > 1:
            yield from pairs(now[1] == now[2], rows)
        yield from flush()

    dealt = cells.repartition(n_parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return map_batches(dealt.select("key", "low", "high", "block", "line", "own", "content"), run, "a binary, b binary, n long")


def line_classes(docs: DataFrame, tables: Tables, edits: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Links between distinct lines of docs (doc_id, uid, text): (node, component) and (line, n_links)."""
    n_parts = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    met = tables.write(shared_keys(key_rows(docs, edits, least, max(n_parts, size // KEY_BUCKET)), n_parts), "met")
    hot = met.where("hot").groupBy("key", "ref").agg(F.max("own").alias("own"))
    members = met.where("not hot").select("key", "ref", "own").union(hot)
    wanted = tables.write(met.select("ref").distinct(), "wanted")
    content = tables.write(texts_of(docs, wanted, least), "contents")
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(apart(blocks), "key").withColumn("block", F.pmod(F.xxhash64("ref", F.lit(5)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "ref", "own").join(content, "ref")
    found = tables.write(links(cells, edits, n_parts), "links")
    tables.drop("met", "wanted", "contents")
    counts = found.where("b is null").groupBy(F.col("a").alias("line")).agg(F.sum("n").alias("n_links"))
    return components(found.where("b is not null").select("a", "b"), tables, "classes"), counts


def removed_lines(docs: DataFrame, tables: Tables, edits: int, least: int, equal: int, repeated: bool) -> DataFrame:
    """(doc_id, uid, places, n_links): the lines that go, and the links of all lines, of documents that have either.

    repeated: whether some rows of docs (doc_id, uid, text) are equal; they count once.
    """
    classes, counts = line_classes(docs, tables, edits, least)
    seen = occurrences(docs, equal)
    seen = tables.write(seen.distinct() if repeated else seen, "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "place")
    per_line = seen.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    known = per_line.join(classes.withColumnRenamed("node", "line"), "line", "left").where("component is not null or times > 1")
    known = tables.write(known.join(counts, "line", "left"), "known")
    linked = known.where("component is not null")
    least_of = linked.groupBy("component").agg(F.min("first").alias("least"))
    goes = linked.join(apart(least_of), "component").select("line", "times", "least", "n_links").union(known.where("component is null").select("line", "times", F.col("first").alias("least"), "n_links"))
    goes = tables.write(goes.select("line", "times", "least", F.coalesce("n_links", F.lit(0)).alias("n_links")), "goes")
    n = seen.count()
    often = F.broadcast(goes.where(F.col("times") >= max(1_000, n // HOT_LINES)).drop("times"))  # HOT_LINES lines at most
    hits = seen.join(often, "line").union(seen.join(often.select("line"), "line", "left_anti").join(apart(goes.drop("times")), "line"))
    hits = hits.select("doc_id", "uid", "n_links", F.when(place != F.col("least"), F.col("place")).alias("place"))
    return hits.groupBy("doc_id", "uid").agg(F.collect_list("place").alias("places"), F.sum("n_links").alias("n_links"))


def _marked(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows with _later: whether a row that is equal in _join and _uid counts as before it; by input partition, then within."""
    if repeated is None:
        return rows.withColumn("_later", F.lit(False))
    dealt = rows.withColumn("_part", F.spark_partition_id())
    several = dealt.join(repeated, ["_join", "_uid"])
    nth = F.row_number().over(Window.partitionBy("_join", "_uid", "_part").orderBy("_part"))
    first = several.groupBy("_join", "_uid").agg(F.min("_part").alias("_first"))
    several = several.withColumn("_nth", nth).join(apart(first), ["_join", "_uid"]).withColumn("_later", (F.col("_nth") > 1) | (F.col("_part") > F.col("_first")))
    columns = [*rows.columns, "_later"]
    return several.select(*columns).union(rows.join(repeated, ["_join", "_uid"], "left_anti").select(*rows.columns, F.lit(False).alias("_later")))


def dedup(docs: DataFrame, *, edits: int = EDITS, least: int = LEAST_CHARS, equal: int | None = EQUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with _kept, _n_lines, _n_removed and _n_links, which replace any of docs.

    _kept is the text without the lines that go; null stays null. Lines of at least equal (1 or more) and fewer than
    least code points lose their exact repeats; with None they all stay.
    """
    tables = Tables(docs.sparkSession, "lines")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), text(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_uid", F.xxhash64("_id", "_text"))
    plain = rows.select(F.col("_id").alias("doc_id"), F.col("_uid").alias("uid"), F.col("_text").alias("text"))
    from_chars = least if equal is None else max(1, min(equal, least))
    several = tables.write(plain.groupBy("doc_id", "uid").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "uid"), "several")
    repeated = None if several.isEmpty() else several.select(F.coalesce("doc_id", F.lit(-1)).alias("_join"), F.col("uid").alias("_uid"))
    gone = tables.write(removed_lines(plain, tables, edits, least, from_chars, repeated is not None), "removed")
    tables.keep_only("removed", "several")
    gone = gone.select(F.coalesce("doc_id", F.lit(-1)).alias("_join"), F.col("uid").alias("_uid"), F.col("places").alias("_places"), F.col("n_links").alias("_links"))
    rows = _marked(rows.select("_row", "_uid", F.coalesce("_id", F.lit(-1)).alias("_join")), repeated)
    joined = rows.join(gone, ["_join", "_uid"], "left")
    raw = F.col("_row")[text_col]
    joined = joined.select("_row", "_links", "_later", "_places", F.split(text(raw), "\n", -1).alias("_lines"))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    every = F.filter(places, lambda i: F.length(F.get("_lines", i)) >= from_chars)
    going = F.when(F.col("_later"), every).otherwise(F.coalesce("_places", F.array().cast("array<int>")))
    joined = joined.select("_row", "_links", "_lines", going.alias("_going"))
    staying = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_going"))
    kept = F.array_join(F.transform(staying, lambda i: F.get("_lines", i)), "\n")
    made = {
        "_kept": F.when(raw.isNull(), F.lit(None)).when(F.size("_going") == 0, text(raw)).otherwise(kept),
        "_n_lines": F.size("_lines").cast("long"),
        "_n_removed": F.size("_going").cast("long"),
        "_n_links": F.coalesce("_links", F.lit(0)).cast("long"),
    }
    joined = joined.select("_row", *(c.alias(n) for n, c in made.items()))
    return joined.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in made), *made)
