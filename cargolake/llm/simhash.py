"""Near-duplicate classes by SimHash and covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the hashes of its word
shingles.  Two fingerprints link when they differ in at most ``radius`` bits.
Candidates come from a covering family of bit masks: each bit position gets a
non-zero vector of ``radius + 1`` bits, and for each non-zero vector v there is
one mask of the positions whose vector has odd product with v.  Any ``radius``
positions leave some v orthogonal to all their vectors, so the pair agrees on
that whole mask: no linked pair is ever missed.

Plan: one pass over the texts writes (id, fingerprint); everything after works
on distinct fingerprints.  A bucket (mask, masked bits) of few fingerprints is
compared inside one row.  A bucket with many is never listed: each member is
sent to itself and to its one-bit neighbours outside the mask, and two members
within two bits meet at such a point, which holds 65 fingerprints at most.
Classes are connected components by smallest label and pointer jumping, each
round a stored table.  A fingerprint with more than 1/10,000 of all rows is
looked up by a broadcast (at most 10,000 such keys exist), the rest by a
shuffled join.

Edge cases: null and empty texts have fingerprint 0 and link like any other; a
null id stays in its class but cannot name it unless all ids there are null;
repeated rows stay, each with its class; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake.llm.common import per_text, prepare, stored

BITS = 64
BUCKET_LIST = 32  # a bucket of more fingerprints takes the neighbour path
HOT_SHARE = 10_000  # a key with more than 1/HOT_SHARE of the rows is hot: fewer than HOT_SHARE such keys exist
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the A-Z-lowered, white-space-split words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total, ones = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        upto = min(total, at + BLOCK)
        columns = [words[at + k:upto + k] for k in range(shingle)]
        hashes = np.fromiter((digest(join(s), seed) for s in zip(*columns)), np.uint64, upto - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, shingle: int = 3, seed: int = 42):
    """The fingerprint of a text column as a signed long."""
    def row(raw: bytes) -> tuple:
        value = fingerprint(raw, shingle, seed)
        return (value - (1 << 64) if value >> 63 else value,)

    return per_text([("fp", pa.int64())], "fp long", row)(text).getField("fp")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 signed masks, such that any ``radius`` positions are all outside one of them."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(bits) if bin((1 + i % vectors) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all those within
    ``radius`` bits (0, 1 or 2): every pair of a short bucket, a star in a long one."""
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    masks = covering_masks(radius)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)
    ])).alias("k")).select("fp", "k.mask", "k.key")
    shared = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keyed.join(shared, ["mask", "key"]), "buckets")
    near = f"bit_count(a ^ b) <= {radius}"
    pairs = f"flatten(transform(m, a -> transform(filter(m, b -> a < b AND {near}), b -> struct(a, b))))"
    short = (members.filter(F.col("n") <= BUCKET_LIST).groupBy("mask", "key").agg(F.collect_list("fp").alias("m"))
             .select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b"))
    flips = [F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(BITS) if not m >> i & 1])
             for m in masks]
    own = F.lit(None)
    for i, flip in enumerate(flips):
        own = F.when(F.col("mask") == i, flip).otherwise(own)
    points = (members.filter(F.col("n") > BUCKET_LIST).select("fp", F.explode(own).alias("flip"))
              .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
              .groupBy("point").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1))
    if radius == 2:  # all at one point are within two bits of each other
        met = points.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b")
    else:
        met = points.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b")
    return short.unionByName(met).distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``pairs`` (a, b)."""
    both = stored(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("over"))
        after = stored(step.join(jump, "root").select("node", "old", F.col("over").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            return labels


def classes(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """``fingerprints`` (doc_id, fp) with ``root``, the class's smallest fingerprint,
    and ``component_id``, the smallest id reachable over links."""
    groups = stored(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "groups")
    roots = connected(links(groups.select("fp"), radius))
    labelled = (groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                .select("fp", "low", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")))
    lowest = labelled.filter("linked").groupBy("root").agg(F.min("low").alias("least"))
    named = stored(labelled.join(lowest, "root", "left").filter("linked OR n > 1")
                   .select("fp", "n", "root", F.coalesce("least", "low").alias("component_id")), "classes")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = named.filter(F.col("n") > total // HOT_SHARE + 1).select("fp", "root", "component_id")
    cold = named.filter(F.col("n") <= total // HOT_SHARE + 1).select("fp", "root", "component_id")
    looked = fingerprints.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "fp", "left")
    out = looked.filter("is_hot").select("doc_id", "fp", "root", "component_id")
    rest = looked.filter("is_hot IS NULL").select("doc_id", "fp").join(cold, "fp", "left")
    return out.unionByName(rest.select("doc_id", "fp", F.coalesce("root", "fp").alias("root"),
                                       F.coalesce("component_id", "doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    prepare(docs.sparkSession)
    prints = stored(docs.select(F.col("doc_id"), fingerprint_column(F.col("text"), shingle, seed).alias("fp")), "prints")
    return classes(prints, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without all but one row of each class: the smallest id stays
    (null ids last, then the smaller fingerprint); one of repeated rows stays."""
    prepare(docs.sparkSession)
    name = "__fp"  # a name that the table does not hold
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    marked = stored(docs.withColumn(name, fingerprint_column(F.col("text"), shingle, seed)), "marked")
    known = classes(marked.select("doc_id", F.col(name).alias("fp")), radius)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")
    first = (known.groupBy("root").agg(F.min(rank).alias("r"))
             .select(F.col("r.doc_id").alias("__id"), F.col("r.fp").alias("__f")))
    kept = marked.join(first, marked["doc_id"].eqNullSafe(first["__id"]) & (marked[name] == first["__f"]), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).select(*[F.col(f"`{c}`") for c in docs.columns])
