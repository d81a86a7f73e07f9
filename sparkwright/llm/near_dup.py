"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct shingles of consecutive words. Two small collections of sketches, each of ROWS
minhashes, are computed; the key of table (i, j) pairs the i-th sketch of the left collection with the j-th of the
right one, so SKETCHES**2 tables of 2*ROWS minhashes cost 2*SKETCHES*ROWS minhashes. At a similarity of 0.8 a link
is missed in all tables with a chance of 2 * (1 - 0.8**ROWS)**SKETCHES, 2 in 100,000.

1. Documents of equal sets are one class, represented by its smallest doc_id; only representatives go on.
2. A left sketch that one representative alone has gives no table entry; the others meet the right sketches.
3. In each bucket of each table, members pair with the smallest member, and pairs of few equal sketches are far. Where
   some are far, all pair with the smallest of those too. Two members that are both near to one of these are in one
   family; any others of the bucket are compared themselves, in cells of two blocks, so that a stranger in a bucket
   hides no pair. The connected families are groups of rather similar documents.
4. Links within a family are confirmed on full sets, in cells of bounded size, by counting common shingles for a whole
   cell at once. In a family of many members these meet its smallest first, then the smallest that has no link with
   it, and only pairs that are not connected through one of the two are compared in cells. A cell returns a spanning
   forest of its links, never its pairs.
5. The links' components, by the smallest doc_id, are the groups of near-duplicates.

No bucket or family is capped: a large one has more cells. Documents without words have an empty set and no links; an
empty table gives no rows. Rows with equal doc_id are one document, whose set holds the shingles of all their texts,
and have one verdict; rows without doc_id are linked with nothing and kept. Columns are the result's own only, so
that other columns of the table may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import WORD, Tables, apart, documents, lower_text, map_arrow, map_groups, partitions
from sparkwright.llm.graph import components

ROWS, SKETCHES = 3, 16
#: Of 2 * SKETCHES sketches, so many equal ones make a pair a candidate: at a similarity of 0.8, 16.4 are expected.
LEAST_EQUAL = 4
#: Members and shingles of a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 384, 1_000_000
#: Members of a side of a cell in which sketches are compared.
SKETCH_BLOCK = 512
#: Families whose centres may be broadcast (two numbers each).
FEW_CENTRES = 1_000_000

_words = re.compile(WORD).findall
_MULTIPLIERS = np.random.default_rng(20_240_917).integers(1, 2**63, 2 * ROWS * SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEPT_WORDS = 150_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; keeps the hashes of words that it has met."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = _words(lower_text(text))
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > _KEPT_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.width + 1)
        h = np.full(n, len(words) if len(words) < self.width else self.width, np.uint64)
        for k in range(min(self.width, len(words))):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
        return np.unique(h)

    def of(self, texts: list[str]) -> np.ndarray:
        """The same of all texts of a document; no shingle runs from one into another."""
        return self(texts[0]) if len(texts) == 1 else np.unique(np.concatenate([self(t) for t in texts]))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """2 * SKETCHES sketches of a non-empty set, each mixed from ROWS minhashes."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[at : at + 512, None] * _MULTIPLIERS).min(0))
    rows = least.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketches, copies) of every document (doc_id, texts, copies); key and sketches are null for empty sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingler = Shingler(width)
        counts, keys, found = [], [], []
        for texts in batch.column(1):
            s = shingler.of(texts.as_py())
            counts.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            found.append(sketch(s).view(np.int64) if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "n_shingles", "set_key", "sketches", "copies"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, set_key binary, sketches array<long>, copies long")


def whole(docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, texts, copies): rows of one doc_id and different texts together, with their number; all others as they are."""
    alone = docs.select("doc_id", F.array("text").alias("texts"), F.lit(1).cast("long").alias("copies"))
    h = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").select("doc_id")
    several = tables.write(several, "several-texts")
    if several.isEmpty():
        return alone
    together = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("texts"), F.count("*").alias("copies"))
    return alone.join(several, "doc_id", "left_anti").union(together)


def rectangles(members: DataFrame, blocks: tuple[Column, Column], contents: DataFrame | None = None) -> DataFrame:
    """members (group, doc_id, left, ...) with low, high and side: cells in which the left ones meet all.

    blocks: how many blocks the left ones and all of a group have, of n_left, n and total (shingles, if there are any).
    contents: further columns by doc_id, joined before a member is copied to its cells.
    """
    weight = F.sum("n_shingles") if "n_shingles" in members.columns else F.lit(0)
    sizes = members.groupBy("group").agg(F.sum(F.col("left").cast("long")).alias("n_left"), F.count("*").alias("n"), weight.alias("total"))
    counts = sizes.select("group", blocks[0].cast("int").alias("n_low"), blocks[1].cast("int").alias("n_high"))
    placed = members.join(apart(counts), "group")
    if contents is not None:
        placed = placed.join(contents, "doc_id")
    deal = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = placed.where("left").withColumn("low", deal("n_low", 1)).withColumn("high", every("n_high")).withColumn("side", F.lit(0))
    two = placed.withColumn("high", deal("n_high", 2)).withColumn("low", every("n_low")).withColumn("side", F.lit(1))
    return one.union(two.select(*one.columns)).drop("n_low", "n_high")


def undecided(both: DataFrame) -> DataFrame:
    """(group, doc_id, left) of both (group, doc_id, near, near2) of those groups in which neither centre reaches all.

    Of groups of the same members one stays. left are those that the first centre does not reach.
    """
    seal = lambda salt: F.bit_xor(F.xxhash64("doc_id", "near", F.lit(salt)))
    open_ = both.groupBy("group").agg(F.bool_or(~F.col("near")).alias("one"), F.bool_or(~F.col("near2")).alias("two"), F.count("*").alias("n"), seal(0).alias("s"), seal(1).alias("t"))
    chosen = open_.where("one and two and n > 1").groupBy("n", "s", "t").agg(F.min("group").alias("group")).select("group")
    return both.join(apart(chosen), "group", "left_semi").select("group", "doc_id", (~F.col("near")).alias("left"))


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a cell's rows, and the places of its two sides."""
    side = rows["side"].to_numpy()
    return rows["doc_id"].to_numpy(), np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def candidates(reps: DataFrame, tables: Tables) -> DataFrame:
    """(a, b): pairs of representatives (doc_id, sketches) that connect all that meet in a bucket with enough equal sketches.

    What a document meets is gathered by its doc_id, one entry a table at most, before sketches are joined to it.
    """
    n_parts = partitions(reps.sparkSession)
    left = reps.select("doc_id", F.posexplode(F.slice("sketches", 1, SKETCHES)).alias("i", "h")).select("doc_id", F.xxhash64("i", "h").alias("left"))
    shared = left.groupBy("left").agg(F.count("*").alias("n")).where("n > 1").select("left")
    lefts = left.join(apart(shared), "left").groupBy("doc_id").agg(F.collect_list("left").alias("lefts")).join(reps, "doc_id")
    right = lefts.select("doc_id", "lefts", F.posexplode(F.slice("sketches", SKETCHES + 1, SKETCHES)).alias("j", "h"))
    buckets = right.select("doc_id", F.explode(F.transform("lefts", lambda x: F.xxhash64(x, "j", "h"))).alias("group"))
    first = buckets.groupBy("group").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("group", "a")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    one = reps.select(F.col("doc_id").alias("a"), F.col("sketches").alias("sa"))
    two = reps.select("doc_id", F.col("sketches").alias("sb"))
    edges = lambda stars: stars.where("near").select("a", F.col("doc_id").alias("b"))

    def compare(met: DataFrame, bucket: Column, met_name: str, name: str) -> DataFrame:
        """(a, doc_id, near, buckets): whether members are near to the centres a of the buckets in which they met."""
        pairs = met.repartition(n_parts, "doc_id").groupBy("doc_id", "a").agg(F.collect_list(bucket).alias("buckets"))
        meets = tables.write(pairs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "buckets")).alias("meets")), met_name)
        each = meets.join(two, "doc_id").select("doc_id", "sb", F.inline("meets"))
        return tables.write(each.join(one, "a").select("a", "doc_id", (equal >= LEAST_EQUAL).alias("near"), "buckets"), name)

    stars = compare(buckets.join(apart(first), "group").where("a <> doc_id"), F.col("group"), "met", "stars")
    if stars.where("not near").isEmpty():
        return edges(stars)
    flagged = stars.select("doc_id", "near", F.explode("buckets").alias("group"))
    second = flagged.where("not near").groupBy("group").agg(F.min("doc_id").alias("a"))
    stars2 = compare(flagged.join(apart(second), "group").where("doc_id <> a"), F.struct("group", F.col("near").alias("near1")), "met-2", "stars-2")
    both = stars2.select("doc_id", F.col("near").alias("near2"), F.inline("buckets")).withColumnRenamed("near1", "near")
    members = undecided(both).groupBy("doc_id").agg(F.collect_list(F.struct("group", "left")).alias("of")).join(reps.select("doc_id", "sketches"), "doc_id")
    open_ = tables.write(members.select("doc_id", "sketches", F.inline("of")), "undecided")
    cells = rectangles(open_, tuple(F.ceil(F.col(n) / SKETCH_BLOCK) for n in ("n_left", "n")))

    def cell(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, low, high = _sides(rows)
        found = np.array([x.as_py() for x in rows["sketches"]], np.int64)
        near = np.zeros((len(low), len(high)), bool)
        for k, at in enumerate(low):
            near[k] = (found[high] == found[at]).sum(1) >= LEAST_EQUAL
        yield from _edges(ids, low, high, near)

    more = map_groups(cells.select("group", "low", "high", "side", "doc_id", "sketches"), ["group", "low", "high"], cell, "a long, b long", n_parts)
    return edges(stars).union(edges(stars2)).union(more)


def _edges(ids: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the graph in which the places low and high of ids are joined where near says so."""
    near &= ids[low][:, None] != ids[high][None, :]
    n = len(low) + len(high)
    whole = np.zeros((n, n), bool)
    whole[: len(low), len(low) :] = near
    whole[len(low) :, : len(low)] = near.T
    who = ids[np.concatenate([low, high])]
    found = [(int(who[x]), int(who[y])) for x, y in forest(whole)]
    if found:
        a, b = np.array(found).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with the adjacency matrix near."""
    n, out = len(near), []
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            out += [(at, int(v)) for v in new]
            todo += new.tolist()
    return out


def common(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of numbers of common elements of sets."""
    n = len(sets)
    values, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = times[ids] > 1
    renumber = np.cumsum(times > 1) - 1
    column, owner = renumber[ids[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, step = np.zeros((n, n), np.float32), 8192
    for at in range(0, int(renumber[-1]) + 1 if len(renumber) else 0, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        dense = np.zeros((n, step), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def links(families: DataFrame, docs: DataFrame, width: int, percent: int, tables: Tables) -> DataFrame:
    """(a, b): links that connect all that are linked within families (doc_id, family, n_shingles)."""
    n_parts = partitions(families.sparkSession)
    sizes = families.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks_of = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES))
    placed = families.join(apart(sizes.select("family", blocks_of("n").cast("int").alias("blocks"))), "family")
    texts = docs.join(placed, "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingler = Shingler(width)
        sets = [shingler.of(t.as_py()).tobytes() for t in batch.column(3)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], [*batch.schema.names[:3], "set"])

    def is_near(both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 100 * both >= percent * (x + y - both)

    def small_family(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, members = rows["doc_id"].to_numpy(), [np.frombuffer(s.as_py(), np.uint64) for s in rows["set"]]
        size = np.array([len(s) for s in members])
        near = is_near(common(members), size[:, None], size[None, :])
        np.fill_diagonal(near, False)
        found = forest(near)
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    made = map_arrow(texts.select("doc_id", "family", "blocks", "texts"), run, "doc_id long, family long, blocks int, set binary")
    sets = tables.write(made, "sets")
    found = map_groups(sets.where("blocks = 1").select("family", "doc_id", "set"), ["family"], small_family, "a long, b long", n_parts)
    large = sets.where("blocks > 1").withColumnRenamed("family", "group")
    if large.isEmpty():
        return found

    def star(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, centre, members = _sides(rows)
        set_of = lambda at: np.frombuffer(rows["set"][int(at)].as_py(), np.uint64)
        mine = set_of(centre[0])
        others = [set_of(at) for at in members]
        both = np.array([np.count_nonzero(_isin(s, mine)) for s in others], np.int64)
        near = is_near(both, len(mine), np.array([len(s) for s in others], np.int64)) if others else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(members), pa.int64()), pa.array([ids[centre[0]]] * len(members), pa.int64()), pa.array(ids[members]), pa.array(near)], ["group", "a", "doc_id", "near"])

    def stars(centres: DataFrame, name: str) -> DataFrame:
        """(group, a, doc_id, near) of all members of the centres' (group, a) families but the centres themselves."""
        block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        named = large.join(F.broadcast(centres) if centres.count() <= FEW_CENTRES else apart(centres), "group")
        ones = named.where("doc_id = a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
        rest = named.where("doc_id <> a").withColumn("block", block).withColumn("side", F.lit(1))
        rows = ones.union(rest.select(*ones.columns)).select("group", "block", "side", "doc_id", "set")
        return tables.write(map_groups(rows, ["group", "block"], star, "group long, a long, doc_id long, near boolean", n_parts), name)

    edges = lambda rows: rows.where("near").select("a", F.col("doc_id").alias("b"))
    one = stars(large.select("group", F.col("group").alias("a")).distinct(), "family-stars")
    found = found.union(edges(one))
    second = tables.write(one.where("not near").groupBy("group").agg(F.min("doc_id").alias("a")), "second-centres")
    if second.isEmpty():
        return found
    two = stars(second, "family-stars-2")
    found = found.union(edges(two))
    both = one.select("group", "doc_id", "near").join(two.select("group", "doc_id", F.col("near").alias("near2")), ["group", "doc_id"])
    open_ = tables.write(undecided(both).join(families.select("doc_id", "n_shingles"), "doc_id"), "undecided-links")
    half = lambda n: F.greatest(F.ceil(2 * F.col(n) / BLOCK_ROWS), F.ceil(2 * F.col("total") * F.col(n) / F.col("n") / BLOCK_SHINGLES))
    cells = rectangles(open_.select("group", "doc_id", "left", "n_shingles"), (half("n_left"), half("n")), large.select("doc_id", "set"))

    def cell(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, low, high = _sides(rows)
        members = [np.frombuffer(s.as_py(), np.uint64) for s in rows["set"]]
        size = np.array([len(s) for s in members])
        yield from _edges(ids, low, high, is_near(common(members)[np.ix_(low, high)], size[low][:, None], size[high][None, :]))

    return found.union(map_groups(cells.select("group", "low", "high", "side", "doc_id", "set"), ["group", "low", "high"], cell, "a long, b long", n_parts))


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents of a Jaccard similarity of percent/100 or more on shingles of width words are linked; component_id is
    the smallest doc_id that a document reaches, and it is kept if that is its own.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "near-dup")
    docs = whole(documents(docs, id_col, text_col), tables)
    all_docs = tables.write(sketches(docs, width), "sketches")
    named = all_docs.where("doc_id is not null and set_key is not null")
    first = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = tables.write(named.join(apart(first), "set_key").select("doc_id", "n_shingles", "rep", "copies", F.when(F.col("doc_id") == F.col("rep"), F.col("sketches")).alias("sketches")), "members")
    reps = members.where("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "sketches")

    soft = components(candidates(reps.select("doc_id", "sketches"), tables), tables, "families")
    families = reps.select("doc_id", "n_shingles").join(soft.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("component", "family")
    found = components(links(tables.write(families, "families"), docs.where("doc_id is not null"), width, percent, tables), tables, "links")

    comp = tables.write(found.select(F.col("node").alias("rep"), "component"), "components")
    tables.keep_only("sketches", "members", "components", "several-texts")
    linked = members.select("doc_id", "n_shingles", "rep", "copies").join(comp, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "copies")
    alone = all_docs.where("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "copies")
    rows = linked.union(alone).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
