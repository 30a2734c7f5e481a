"""Exact deduplication of batches against immutable snapshots.

A snapshot keeps one row for each distinct text: SHA-256 digest, length, the largest id and
how many rows had it, in hash buckets, and for each bucket a static binary-fuse filter.
A new batch is first grouped by itself; its distinct digests are screened by the filters, and
only positives are joined with the exact rows of the snapshot. Rows of a group of two or more
are then compared byte by byte with the text that represents their digest.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import fuse
from meshlark.llm.spread import BROADCAST_ROWS, Tables, kept, keyed_join, scratch

#: Distinct digests that a bucket holds, about; a bucket is handled in one task.
BUCKET_KEYS = 200_000
LEAST_BUCKETS = 48
#: Bits of the screen of repeated digests.
SCREEN_BITS = 1 << 26


class Snapshot(NamedTuple):
    """Folders of a snapshot's tables: ``digests`` (sha, n_bytes, keep_id, n, bucket) and ``filters`` (bucket, fused)."""

    path: str
    buckets: int

    def digests(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/digests")

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/filters")


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sha (hex) and n_bytes of each row; null counts as the empty text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.sha2(whole, 256).alias("sha"), F.octet_length(whole).cast("bigint").alias("n_bytes"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: sha, n_bytes, keep_id (largest id), n. Counted before the shuffle, so copies cost nothing."""
    return rows.groupBy("sha", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _key(sha) -> F.Column:
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")


def write_snapshot(groups: DataFrame, path: str, rows: int) -> Snapshot:
    """Writes a snapshot of ``groups`` (as ``grouped`` gives them) with filters; ``rows`` sets the number of buckets. Never changed afterwards."""
    spark = groups.sparkSession
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_KEYS))
    groups.withColumn("bucket", F.pmod(_key(F.col("sha")), F.lit(buckets)).cast("int")).repartition("bucket").write.parquet(f"{path}/digests")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [int(part["bucket"].iloc[0])], "fused": [fuse.build(part["key"].to_numpy(np.uint64))]})

    keys = spark.read.parquet(f"{path}/digests").select("bucket", _key(F.col("sha")).alias("key"))
    keys.groupBy("bucket").applyInPandas(build, "bucket int, fused binary").write.parquet(f"{path}/filters")
    return Snapshot(path, buckets)


def screened(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``groups`` with ``maybe``: whether the filter of the digest's bucket holds it."""
    spark = groups.sparkSession
    incoming = groups.withColumn("bucket", F.pmod(_key(F.col("sha")), F.lit(snapshot.buckets)).cast("int")).withColumn("key", _key(F.col("sha")))

    def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        packed = filters["fused"].iloc[0] if len(filters) else b""
        return rows.assign(maybe=fuse.holds(packed, rows["key"].to_numpy(np.uint64)))[["sha", "n_bytes", "keep_id", "n", "maybe"]]

    id_type = groups.schema["keep_id"].dataType.simpleString()
    return incoming.groupBy("bucket").cogroup(snapshot.filters(spark).groupBy("bucket")).applyInPandas(probe, f"sha string, n_bytes bigint, keep_id {id_type}, n bigint, maybe boolean")


def merged(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups of batch and snapshot together: sha, n_bytes, keep_id, n. Only screened positives are joined."""
    spark = groups.sparkSession
    seen = kept(screened(groups, snapshot))
    known = snapshot.digests(spark).select("sha", "n_bytes", "keep_id", "n")
    hits = seen.filter("maybe").select("sha", "n_bytes", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    both = kept(hits.join(known, ["sha", "n_bytes"]).select("sha", "n_bytes", F.greatest("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.col("new_n")).alias("n")))
    names = both.select("sha")
    fresh_rows = seen.filter("not maybe").drop("maybe").unionByName(seen.filter("maybe").drop("maybe").join(names, "sha", "left_anti"))
    return both.unionByName(fresh_rows).unionByName(known.join(names, "sha", "left_anti"))


def differing(docs: DataFrame, groups: DataFrame, total: int, doc_id: str, text: str, work: Tables) -> DataFrame:
    """Digests of which some row has other bytes than the row that stays: none, unless SHA-256 collides.

    Only rows of repeated digests are moved with their texts: those digests are broadcast if they are few, after they were counted;
    otherwise a screen of a fixed number of bits decides which rows meet them in a shuffle, and lets some others through in vain.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    repeated = work.keep("repeated", groups.filter("n > 1").select("sha", "keep_id", "n"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(whole, 256).alias("sha"), whole.alias("text"))
    if repeated.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(repeated), "sha")
    else:
        rows = keyed_join(screen(rows, repeated), repeated, "sha", "n", total, F.col("doc_id")).filter("n > 1")
    # copies of a text are dealt out by salts, each of which gets the text that stays
    salts = F.ceil(F.col("n") / 500).cast("int")
    heads = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["sha"]).select("sha", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("text").alias("head"))
    tails = rows.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("sha", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), "text")
    return tails.join(heads, ["sha", "salt"]).filter(F.col("text") != F.col("head")).select("sha").distinct()


def screen(rows: DataFrame, repeated: DataFrame, bits: int = SCREEN_BITS) -> DataFrame:
    """``rows`` whose digest may be among ``repeated``: the words of the bits that those set are broadcast, ``bits`` / 64 rows at most."""
    place = F.pmod(_key(F.col("sha")), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    set_bits = repeated.groupBy(F.floor(place / 64).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))
    mine = rows.withColumn("word", F.floor(place / 64).cast("bigint"))
    met = mine.join(F.broadcast(set_bits), "word")
    return met.filter(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def exact_groups(docs: DataFrame, batches: int = 2, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` arrives in ``batches`` (dealt by a hash of the id): the first becomes a snapshot, each
    further one is screened against the snapshot before it and gives the next. Texts are equal if
    identical; null is the empty text; of equal texts the largest id stays. Equal ids with equal texts
    are one document: each such row says the same. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "exact")
    rows = kept(digest_rows(docs, doc_id, text))
    total = rows.count()
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    groups = grouped(rows.filter(arrival == 0))
    for k in range(1, batches):
        before = write_snapshot(groups, f"{path}/{k}", total)
        groups = merged(grouped(rows.filter(arrival == k)), before)
    groups = kept(groups)
    bad = kept(differing(docs, groups, total, doc_id, text, Tables(spark, "exact")))
    if bad.isEmpty():
        table = groups.filter("n > 1").select("sha", "keep_id", "n")
        out = keyed_join(rows, table, "sha", "n", total, F.col("doc_id"))
    else:  # a digest that two texts share: those rows are grouped by their bytes
        whole = F.coalesce(F.col(text), F.lit(""))
        texts = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(whole, 256).alias("sha"), whole.alias("text")).join(bad, "sha", "left_semi")
        split = texts.join(texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "text").select("doc_id", "sha", F.lit(None).cast("bigint").alias("n_bytes"), "keep_id", "n")
        clear = rows.join(bad, "sha", "left_anti")
        out = keyed_join(clear, groups.filter("n > 1").select("sha", "keep_id", "n"), "sha", "n", total, F.col("doc_id")).unionByName(split)
    keep = F.coalesce(F.col("keep_id"), F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce(F.col("n"), F.lit(1)).cast("bigint").alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))
