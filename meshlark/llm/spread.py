"""Helpers that keep hot keys, shared folders and column names safe."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more than ``total / HOT_KEYS`` rows is hot, so at most HOT_KEYS keys are.
HOT_KEYS = 2000
#: No key of fewer rows than this is hot; so low that from 40,000 rows on the share alone decides, and tables of any size run the same joins.
HOT_LEAST = 20
#: Most rows of a table that is broadcast, after its rows were counted.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Ours only where the session names none and runs on one machine, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "/tmp/checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


class Tables:
    """Tables that a job writes in the shared folder to cut lineage: each name's newest version is kept, older ones are deleted."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.paths, self.made = spark, scratch(spark, what), {}, 0

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as written and read again. Frames that read an older table of the same name end with this."""
        self.made += 1
        path = f"{self.path}/{name}-{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            remove(self.spark, path)


def kept(df: DataFrame) -> DataFrame:
    """The frame cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it (case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def keyed_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, spread) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has a row for each value of ``key`` and in ``size`` how many rows have it.

    Hot keys are joined by broadcast: at most HOT_KEYS of them can exist. Rows of the others
    meet in a shuffle join in which no key has more than ``total / HOT_KEYS`` rows (HOT_LEAST at least).
    ``spread``: a column that is unique or nearly so, to deal out the rows that are done.
    A null key finds nothing.
    """
    more = [c for c in table.columns if c != key]
    taken = [*rows.columns, *table.columns]
    k1, k2, is_hot, own, salt, salt2, h, c_ = (fresh(taken, x) for x in ("hot_key", "cold_key", "is_hot", "own_key", "salt_of_row", "salt_of_key", "h", "c"))
    hot = F.col(size) > max(HOT_LEAST, total // HOT_KEYS)
    first = table.filter(hot).select(F.col(key).alias(k1), *[F.col(c).alias(f"{h}_{c}") for c in more], F.lit(True).alias(is_hot))
    rest = table.filter(~hot).select(F.col(key).alias(k2), *[F.col(c).alias(f"{c_}_{c}") for c in more])
    met = rows.join(F.broadcast(first), F.col(key) == F.col(k1), "left").drop(k1)
    kind = table.schema[key].dataType.simpleString()
    away = F.lit(None).cast(kind)
    met = met.withColumn(own, F.when(F.col(is_hot).isNull(), F.col(key)).otherwise(away)).withColumn(salt, F.when(F.col(own).isNull(), F.xxhash64(spread)))
    rest = rest.withColumn(salt2, F.lit(None).cast("bigint"))
    met = met.join(rest, F.col(own).eqNullSafe(F.col(k2)) & F.col(salt).eqNullSafe(F.col(salt2)), "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"{h}_{c}"), F.col(f"{c_}_{c}")).alias(c) for c in more])
