"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a fingerprint within r bits of both. So every distinct fingerprint
emits all variants within r bits of itself (65 for r = 1), variants are shuffled, and fingerprints that meet at a
variant are linked once their distance is verified. No more than 65 distinct fingerprints lie within one bit of a
variant, so groups are small whatever the data; exact copies have one fingerprint and count once. Links chain the
fingerprints at a variant in order instead of pairing them all, and components come from rounds of large-star and
small-star over the links, each a join and an aggregation, with a checkpoint after each round.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealframe.llm.shared import cut, slices, small

BITS = 64


def fingerprint_text(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer; 0 if it has no word.

    A-Z are lower-cased, words end at space and \\t to \\r, shingles are joined with a space and count as often as they
    occur; a text of fewer words is one shingle. A bit is 1 if it is set in over half of the shingles' XXH64.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) > shingle else [words]
    hashes = np.array([xxh64_intdigest(x, seed) for x in map(b" ".join, runs)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) of every row; null and empty texts have fingerprint 0."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def mark(batches):
        for batch in slices(batches):
            fps = [fingerprint_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(mark, f"doc_id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """Every change of at most `radius` bits, as signed 64-bit integers."""
    found = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """a < b: linked pairs of the distinct fingerprints in column fp that connect all that are within `distance` bits.

    Fingerprints within the radius of one variant are at most 2 * radius apart, so linking neighbours in order connects
    them all. For an odd distance the radius is rounded up and neighbours may be too far apart; each fingerprint then
    pairs with all others of its variant (at most 65 for radius 1) before the distance is verified.
    """
    radius = -(-distance // 2)
    variants = F.explode(F.transform(F.array(*(F.lit(m) for m in masks(radius))), lambda m: F.col("fp").bitwiseXOR(m)))
    balls = distinct.select("fp", variants.alias("variant"))
    if distance % 2 == 0:
        at = Window.partitionBy("variant").orderBy("fp")
        met = balls.select(F.lag("fp").over(at).alias("a"), F.col("fp").alias("b")).where("a is not null")
    else:
        met = balls.withColumnRenamed("fp", "a").join(balls.withColumnRenamed("fp", "b"), "variant").where("a < b").select("a", "b")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes of edges (a, b); self-links are dropped.

    Alternates large-star (a node links its larger neighbours to its smallest one) and small-star (it links its smaller
    neighbours and itself to the smallest) until nothing changes. A node with many neighbours is aggregated before the
    shuffle and its join is one that Spark can split.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = cut(star.distinct())
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(least, "u").select("u", "v", "m")
        edges = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classify(marked: DataFrame, distance: int = 2) -> DataFrame:
    """component_id of every row of (doc_id, fp): the smallest doc_id among rows linked to it, itself included.

    Rows may repeat. A null doc_id never names a component: a component of nulls alone has component_id null.
    marked should be a checkpoint or a table, as it is read several times.
    """
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups.select("fp"), distance))
    named = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(named.join(lowest, "root").select("fp", "component_id"))
    return marked.join(small(of), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of docs; other columns are ignored, an empty table gives no rows."""
    return classify(cut(fingerprints(docs, doc_id, text)), distance)


def keep_one(docs: DataFrame, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: that of its smallest doc_id.

    Of rows that share this doc_id, one is kept. Rows whose doc_id is null can't be told apart by it and are kept.
    """
    gone = near_duplicates(docs, distance, doc_id, text).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(small(cut(gone)), docs[doc_id] == F.col("__gone"), "left_anti")
    first = Window.partitionBy(doc_id).orderBy(F.xxhash64(F.struct(*left.columns)))
    repeated = cut(docs.groupBy(doc_id).count().where("count > 1").where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__twice")))
    if repeated.isEmpty():
        return left
    single = left.join(small(repeated), left[doc_id] == F.col("__twice"), "left_anti")
    twice = left.join(small(repeated), left[doc_id] == F.col("__twice"), "left_semi")
    return single.unionAll(twice.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
