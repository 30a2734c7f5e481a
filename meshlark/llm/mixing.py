"""Mixing sources to target weights by repeating and thinning documents.

Words are summed for each source, targets are set by weight under a cap, and
rate = target / words of the source. Each document is then taken floor(rate) times,
plus once more with the probability rate - floor(rate), decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm.spread import BROADCAST_ROWS, fresh, kept

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame, source: str) -> DataFrame:
    """``sources`` with ``rank``: their place from 0 by code point, null last.

    Sorted by range partitions; only the number of rows of each partition comes to the driver.
    """
    order = [F.col(source).isNull().asc(), F.col(source).asc()]
    placed = sources.repartitionByRange(8, *order).sortWithinPartitions(*order)
    at_row = fresh(sources.columns, "at_row")
    placed = kept(placed.select("*", F.monotonically_increasing_id().alias(at_row)))
    part = F.shiftright(at_row, 33)
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())
    before, at = [F.lit(-1), F.lit(0)], 0
    for p in sorted(sizes):
        before += [F.lit(p).cast("bigint"), F.lit(at).cast("bigint")]
        at += sizes[p]
    before[0], before[1] = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")
    return placed.withColumn("rank", F.create_map(*before)[part] + F.col(at_row).bitwiseAND(F.lit((1 << 33) - 1))).drop(at_row)


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``weight`` and ``target`` (double) to a frame of one row for each source.

    Targets share ``share`` of all words by weight; weights repeat in the order of the sources.
    A target stops at ``cap`` times its source's words and the rest is shared again, until none
    is above. Where even all caps together are less than the share, every target is its cap.
    """
    table = ranked(sizes, source)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    most = fresh(table.columns, "most")
    table = kept(table.withColumn(most, F.col(size) * F.lit(cap)))
    total = (table.agg(F.sum(size)).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        above = F.lit(False) if full < 0 else F.col("weight") * F.lit(level) > F.col(most)
        n, capped, open_weight = table.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col(most))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_weight:
            level = level if open_weight else float("inf")
            break
        full, level = n, (total - capped) / open_weight
    return table.withColumn("target", F.when(F.col("weight") * F.lit(level) > F.col(most), F.col(most)).otherwise(F.col("weight") * F.lit(level))).drop(most, "rank")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that only the seed and the id decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rate_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what the mix decides for each row, and the names of the new columns by role.

    Roles: size (words, 0 for a null or empty text), source_size, target, copies (times the row is taken).
    A null source is a source of its own. Repeated rows and equal ids draw the same number.
    An empty table gives an empty one; a source without words gets the target 0 and no copies.
    """
    names = {r: fresh(docs.columns, f"mix_{r}") for r in ("size", "source_size", "target", "copies")}
    sized = docs.withColumn(names["size"], word_count(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum(names["size"]).alias("source_size"))
    own = fresh([*docs.columns, *names.values()], "mix_source")
    table = targets(sizes, weights=weights, share=share, cap=cap).select(F.col("source").alias(own), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]))
    if table.count() <= BROADCAST_ROWS:
        met = sized.join(F.broadcast(table), F.col(source).eqNullSafe(F.col(own)), "left")
    else:  # sources without bound: salted, since one may hold a third of all rows
        met = _salted(sized, table, source, own, doc_id)
    rate = F.when(F.col(names["source_size"]) > 0, F.col(names["target"]) / F.col(names["source_size"])).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col(doc_id), seed) < rate - F.floor(rate), 1).otherwise(0)
    return met.withColumn(names["copies"], copies.cast("bigint")).select(*docs.columns, *names.values()), names


def _salted(sized: DataFrame, table: DataFrame, source: str, own: str, doc_id: str, salts: int = 64) -> DataFrame:
    of_row, of_key = (fresh([*sized.columns, *table.columns], x) for x in ("salt_of_row", "salt_of_key"))
    sized = sized.withColumn(of_row, F.pmod(F.xxhash64(doc_id), F.lit(salts)))
    wide = table.withColumn(of_key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return sized.join(wide, F.col(source).eqNullSafe(F.col(own)) & (F.col(of_row) == F.col(of_key)), "left")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``rate_documents`` says, with the columns of ``docs``."""
    rated, names = rate_documents(docs, **options)
    copy = fresh(rated.columns, "copy")
    return rated.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(names["copies"]).cast("int")))).select(*docs.columns)
