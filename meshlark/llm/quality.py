"""Quality selection by importance resampling on hashed n-grams.

Two generative models, bags of hashed words and word pairs, are counted: one of all (raw) text,
one of target text (documents labelled good). A document's log weight is the sum of the log ratios
of its n-grams, that is the log of the ratio of its probabilities. Documents are drawn without replacement by Gumbel top-k on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm import textbytes as tb
from meshlark.llm.mixing import draw
from meshlark.llm.spread import fresh, kept

#: Buckets of words and of pairs of words.
WORD_BUCKETS, PAIR_BUCKETS = 1 << 18, 1 << 16
_PARTS = 40
#: Groups in which counts of map tasks are added up at first.
_SALTS = 1024
#: Occurrences that each count is drawn towards its expectation by.
PRIOR = 2.0
#: Labelled rows that the target model and the share to draw are fitted on, about (chosen by a hash of the id).
LABELLED_ROWS = 100_000


def _features(chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of the chunk) and buckets of all its words and pairs. Runs of punctuation are words; pairs of a word with itself share a bucket."""
    found = tb.runs(chunk)
    h = tb.word_hashes(chunk, found)
    row = np.repeat(np.arange(len(chunk.at) - 1), np.diff(found.at))
    pair = tb.gram_hashes(h, 2)
    inside = row[1:] == row[:-1]
    pair[h[1:] == h[:-1]] = 0
    return np.concatenate([row, row[:-1][inside]]), np.concatenate([h % np.uint64(WORD_BUCKETS), pair[inside] % np.uint64(PAIR_BUCKETS) + np.uint64(WORD_BUCKETS)]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = WORD_BUCKETS + PAIR_BUCKETS
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        good = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
        for chunk in tb.chunks(batch.column(0)):
            row, bucket = _features(chunk)
            raw += np.bincount(bucket, minlength=size)
            target += np.bincount(bucket[good[chunk.first : chunk.last][row]], minlength=size)
    step = size // _PARTS
    for k in range(_PARTS):
        part = slice(k * step, (k + 1) * step)
        if raw[part].any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "salt": pa.array([TaskContext.get().partitionId() % _SALTS], pa.int32()), "raw": pa.array([raw[part].tobytes()], pa.binary()), "target": pa.array([target[part].tobytes()], pa.binary())})


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = {c: sum(np.frombuffer(x, np.int64) for x in rows[c]) for c in ("raw", "target")}
    return pd.DataFrame({"part": rows["part"].iloc[:1], "salt": rows["salt"].iloc[:1], **{c: [v.tobytes()] for c, v in total.items()}})


class Ratio(NamedTuple):
    """Counts of each bucket, and target n-grams for each raw one, by kind.

    The ratio of a bucket is log((target + PRIOR) / (raw * share + PRIOR)): neutral where little is known. An n-gram's own
    document is left out of both counts, so labelled and other documents compare.
    """

    raw: np.ndarray
    target: np.ndarray
    share: tuple[float, float]

    def log(self, bucket: np.ndarray, own_raw, own_target) -> np.ndarray:
        share = np.where(bucket < WORD_BUCKETS, *self.share)
        return np.log((np.maximum(self.target[bucket] - own_target, 0) + PRIOR) / (np.maximum(self.raw[bucket] - own_raw, 0) * share + PRIOR))


def ratio_of(raw: np.ndarray, target: np.ndarray) -> Ratio:
    parts = (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, None))
    share = tuple(float(target[p].sum() / max(raw[p].sum(), 1)) for p in parts)
    return Ratio(raw, target, share)


def _weigh(text_at: int, good_at: int, ratio_of_task, name: str) -> object:
    """Appends the log weight in place of the column that tells which rows are in the target's sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio: Ratio = ratio_of_task()
        size = WORD_BUCKETS + PAIR_BUCKETS
        for batch in batches:
            out = np.full(batch.num_rows, -np.inf)
            good = np.asarray(batch.column(good_at).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for chunk in tb.chunks(batch.column(text_at)):
                row, bucket = _features(chunk)
                n = len(chunk.at) - 1
                once, many = np.unique(row * size + bucket, return_counts=True)
                row, bucket = once // size, once % size
                log = ratio.log(bucket, many, many * good[chunk.first : chunk.last][row])
                out[chunk.first : chunk.last] = np.where(np.bincount(row, minlength=n) > 0, np.bincount(row, log * many, n), -np.inf)
            keep = [k for k in range(batch.num_columns) if k != good_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.float64(), mask=np.isinf(out))], [*(batch.schema.names[k] for k in keep), name])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", good: str = "good", rows: int = LABELLED_ROWS) -> tuple[Ratio, DataFrame]:
    """The models' ratio, and the labelled sample (id, good) that they learn the target from.

    ``labels``: id and a boolean of each labelled document; an id with labels that differ is not good.
    Raw text is every document; only the labels are sampled, to about ``rows`` of them.
    """
    taken, by = (fresh(docs.columns, x) for x in ("is_target", "labelled_id"))
    sample = labels.groupBy(F.col(doc_id).alias(by)).agg(F.min(F.coalesce(F.col(good), F.lit(False))).alias(taken))
    share = min(1.0, rows / max(1, labels.count()))
    sample = kept(sample.filter(F.col(by).isNotNull() & (draw(F.col(by), "labelled") < share)))
    flagged = docs.select(text, doc_id).join(F.broadcast(sample), F.col(doc_id) == F.col(by), "left").select(text, taken)
    kinds = "part int, salt int, raw binary, target binary"
    parts = flagged.mapInArrow(_count, kinds).groupBy("part", "salt").applyInPandas(_add, kinds).groupBy("part").applyInPandas(_add, kinds).collect()
    raw, target = np.zeros(WORD_BUCKETS + PAIR_BUCKETS, np.int64), np.zeros(WORD_BUCKETS + PAIR_BUCKETS, np.int64)
    step = len(raw) // _PARTS
    for p in parts:
        raw[p["part"] * step : (p["part"] + 1) * step] = np.frombuffer(p["raw"], np.int64)
        target[p["part"] * step : (p["part"] + 1) * step] = np.frombuffer(p["target"], np.int64)
    return ratio_of(raw, target), sample


def weigh(docs: DataFrame, ratio: Ratio, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with each row's log weight (null without words), and the column's name."""
    name = fresh(docs.columns, "log_weight")
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    by, taken = sample.columns
    flagged = docs.join(F.broadcast(sample), F.col(doc_id) == F.col(by), "left").select(*docs.columns, taken)
    out = flagged.mapInArrow(_weigh(docs.columns.index(text), len(docs.columns), lambda: sent.value, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
    return out, name


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The ``k``-th largest value of a column, found by counting in ever smaller bins; only bins come to the driver."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    for _ in range(12):
        width = (high - low) / bins
        if not width or low + width == low:
            break
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = sorted(keys.filter(F.col(column).between(low, high)).groupBy(at.alias("b")).count().collect(), reverse=True)
        for b, n in counts:
            if above + n >= k:
                break
            above += n
        inner = keys.filter(F.col(column).between(low, high) & (at == b)).agg(F.min(column), F.max(column)).first()
        if inner[0] == inner[1]:
            return inner[0]
        low, high = inner
    return low


def select(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", good: str = "good", recall: float = 0.99, seed: str = "quality") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with log_weight (double) and kept (boolean), and these columns' names by role.

    k is the number of documents whose weight reaches what ``recall`` of the labelled good ones reach; the k
    largest of log weight + Gumbel noise are kept. The noise is decided by a hash of the id and the text, so
    reruns agree; rows that tie with the k-th are kept. Rows without words (null or empty text) are not kept. Without good labels nothing can be
    told apart and every row with words is kept.
    """
    ratio, sample = fit(docs, labels, doc_id, text, good)
    weighed, weight = weigh(docs, ratio, sample, doc_id, text)
    name = fresh(weighed.columns, "kept")
    u = draw(F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(text).cast("string")), seed)
    key = F.col(weight) - F.log(-F.log(u + F.lit(2.0**-54)))
    slim = kept(weighed.select(F.col(doc_id).alias("id"), F.col(weight).alias("w"), key.alias("key")))
    known = slim.join(F.broadcast(sample.toDF("id", "target").filter("target").select("id")), "id", "left_semi")
    least = known.agg(F.percentile_approx("w", F.lit(1 - recall), F.lit(100_000))).first()[0]
    least = float("-inf") if least is None else least
    k = slim.filter(F.col("w") >= least).count()
    bound = kth_largest(slim.filter("key is not null").select("key"), "key", k)
    return weighed.withColumn(name, F.coalesce(key >= bound, F.lit(False))), {"log_weight": weight, "kept": name}


def selected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``select`` keeps."""
    rows, names = select(docs, labels, **options)
    return rows.filter(names["kept"]).select(*docs.columns)
