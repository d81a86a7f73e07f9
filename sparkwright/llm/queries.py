"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import byte_bpe, licenses, line_dedup, mixing, near_dup, pii, quality, suffix_dedup, topk, toxicity
from sparkwright.llm.common import Tables, load


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to equal or similar lines before them, its lines' links, and a digest of the rest."""
    found = line_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_links").alias("n_links"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    docs = load(spark, sf_dir, "documents")
    text = F.col("text")
    sized = docs.select("doc_id", "source", mixing.words(text).alias("size"), mixing.quality_weight(text).alias("weight"))
    sized = Tables(spark, "op2").write(sized, "sizes")
    mixed = mixing.mix(sized, F.col("size"), F.col("weight"), ties=F.col("size"))
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and the labels of every document."""
    found = licenses.scan(load(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        "score",
    )


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates of all documents, on sets of four-word shingles."""
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = load(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each document loses to passages of documents before it, and a digest of the rest."""
    found = suffix_dedup.dedup(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a fifth of the labels, by a checksum of doc_id, is held out."""
    docs, held_out = load(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lexicon = toxicity.train(docs, load(spark, sf_dir, "labels"), ~held_out)
    rated = toxicity.rate(docs, lexicon)
    return rated.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows by inner product for every vector whose id is divisible by 50."""
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(load(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = load(spark, sf_dir, "documents")
    trees = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.assess(docs, trees)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_licenses, op4_near_dup, op5_pii, op6_suffix_dedup, op7_toxicity, op8_top_k, op9_byte_bpe, op10_quality)}

ORACLES = {
    "op1_line_dedup": r"""
        with recursive places as (
            select doc_id, unnest(str_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) - 1 as place
            from documents
        ),
        -- levenshtein counts bytes, so letters of more than one get a byte each
        distinct_lines as (
            select line, length(line) as n, translate(line, 'ÄÖÜäöüßÉÈÊÇéèêçÓÍÑóíñ', array_to_string(list_transform(range(1, 22), lambda i: chr(i::int)), '')) as bytes
            from (select distinct line from places where length(line) >= 20)
        ),
        segments as (
            select line, n, i, (n // 3) * i + greatest(0, i - (3 - n % 3)) as start, n // 3 + (i >= 3 - n % 3)::int as size
            from distinct_lines, unnest([0, 1, 2]) as t(i)
        ),
        probes as (
            select line, n - delta as short, i, substr(line, (((n - delta) // 3) * i + greatest(0, i - (3 - (n - delta) % 3)) + shift + 1)::bigint,
                                                       (((n - delta) // 3) + (i >= 3 - (n - delta) % 3)::int)::bigint) as content
            from distinct_lines, unnest([0, 1, 2]) as t(i), unnest([0, 1, 2]) as u(delta), unnest([-2, -1, 0, 1, 2]) as v(shift)
            where ((n - delta) // 3) * i + greatest(0, i - (3 - (n - delta) % 3)) + shift >= 0
        ),
        links as (
            select distinct s.line as a, p.line as b
            from segments s join probes p on p.short = s.n and p.i = s.i and p.content = substr(s.line, (s.start + 1)::bigint, s.size::bigint) and p.line <> s.line
            join distinct_lines x on x.line = s.line join distinct_lines y on y.line = p.line
            where levenshtein(x.bytes, y.bytes) <= 2
        ),
        both_ways as (select a, b from links union select b, a from links),
        reach(line, r) as (
            select a, a from both_ways
            union
            select e.b, r.r from reach r join both_ways e on e.a = r.line
        ),
        classes as (select line, min(r) as class from reach group by line),
        counts as (select a as line, count(*) as n_links from both_ways group by a),
        marked as (
            select p.doc_id, p.place, p.line, coalesce(n_links, 0) as n_links,
                   length(p.line) >= 1 and row_number() over (partition by coalesce(class, p.line) order by doc_id, place) > 1 as goes
            from places p left join classes using (line) left join counts using (line)
        )
        select doc_id, count(*)::bigint as n_lines, count_if(goes)::bigint as n_removed, sum(n_links)::bigint as n_links,
               sha256(coalesce(string_agg(line, chr(10) order by place) filter (not goes), '')) as kept_sha256
        from marked group by doc_id
    """,
    "op2_mixing": r"""
        with docs as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                   coalesce(0.5::double + (length(translate(text, '#*$%&|<>', '')) + 1)::double / (length(text) + 1), 1.0::double) as weight
            from documents
        ),
        keyed as (
            select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':0'), 1, 12))::bigint::double + 0.5::double) / 281474976710656.0::double) / weight as key
            from docs
        ),
        sources as (
            select source, source_size, 2 * source_size as cap, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
            from (select source, sum(size)::bigint as source_size from docs group by source)
        ),
        levels as (
            select *, row_number() over (order by cap::double / weight, source nulls last) as place,
                   (sum(source_size) over ()::double * 1.5::double
                    - (sum(cap) over (order by cap::double / weight, source nulls last rows unbounded preceding) - cap)::double)
                   / (sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following))::double as level
            from sources
        ),
        goals as (
            select source, source_size, least(cap::double, weight * (select coalesce(min_by(level, place), 0.0::double) from levels where level <= cap::double / weight)) as target
            from levels
        ),
        placed as (
            select k.doc_id, k.size, g.source_size, g.target,
                   (sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) - k.size)::bigint as before,
                   case when g.source_size > 0 then floor(g.target / g.source_size)::bigint else 0 end as epochs
            from keyed k join goals g on k.source is not distinct from g.source
        )
        select doc_id, size, source_size, target,
               (epochs + (size > 0 and 2 * before + size <= 2 * (target - epochs * source_size))::bigint) * size as taken
        from placed
    """,
    "op4_near_dup": r"""
        with recursive words as (
            select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
            from documents
        ),
        shingles as (
            select distinct doc_id, s
            from (
                select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
                from words
            )
        ),
        sizes as (select doc_id, count(*)::bigint as n_shingles from shingles group by doc_id),
        pairs as (
            select a.doc_id as a, b.doc_id as b, count(*) as both
            from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
            group by a.doc_id, b.doc_id
        ),
        links as (
            select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b
            where 100 * p.both >= 80 * (x.n_shingles + y.n_shingles - p.both)
        ),
        both_ways as (select a, b from links union all select b, a from links),
        reach(doc_id, r) as (
            select doc_id, doc_id from documents
            union
            select e.b, r.r from reach r join both_ways e on e.a = r.doc_id
        ),
        least_reached as (select doc_id, min(r) as component_id from reach group by doc_id)
        select d.doc_id, coalesce(n_shingles, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
        from documents d left join sizes using (doc_id) join least_reached using (doc_id)
    """,
    "op6_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        windows as (
            select doc_id, p, substr(h, 2 * p + 1, 100) as s
            from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) as p from d)
        ),
        later as (
            select distinct doc_id, p
            from (select doc_id, p, min(doc_id) over (partition by s) as first_id from windows)
            where doc_id > first_id
        ),
        marked as (
            select doc_id, p, coalesce(p > lag(p) over (partition by doc_id order by p) + 50, true)::int as starts
            from later
        ),
        runs as (
            select doc_id, min(p) as a, max(p) + 50 as b
            from (select doc_id, p, sum(starts) over (partition by doc_id order by p) as run from marked)
            group by doc_id, run
        ),
        pieces as (
            select r.doc_id, r.a, r.b, substr(d.h, 2 * coalesce(lag(r.b) over (partition by r.doc_id order by r.a), 0) + 1,
                                              2 * (r.a - coalesce(lag(r.b) over (partition by r.doc_id order by r.a), 0))) as before
            from runs r join d using (doc_id)
        ),
        removed as (
            select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans, max(b) as last, string_agg(before, '' order by a) as kept
            from pieces group by doc_id
        )
        select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join removed using (doc_id)
    """,
    "op8_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        parts as (select vec_id, generate_subscripts(v, 1) as d, unnest(v) as x from v),
        scored as (
            select q.vec_id as query_id, c.vec_id as vec_id, sum(q.x * c.x)::bigint as score
            from parts q join parts c on q.d = c.d and q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
            group by q.vec_id, c.vec_id
        )
        select query_id, rank::int as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        where rank <= 5
    """,
}
