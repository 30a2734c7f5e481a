"""Finds passages of a benchmark in documents: a prefix-filtered join of shingle sets.

A window is ``window`` consecutive words of an item (the whole item, if it is shorter). Its set
is its shingles of five words (all its words, if fewer). Whole containment needs every shingle,
so the prefix to join on is one shingle: the window's rarest, by counts over all documents.
A hit of that shingle fixes where the window would lie; length and position bounds drop what would
begin before or end after the document, and the words of the rest are compared one by one.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm import textbytes as tb
from meshlark.llm.spread import Tables, fresh

SHINGLE = 5
#: Windows that one broadcast index holds at most (about 150 bytes each); a larger benchmark is handled in blocks.
BLOCK_WINDOWS = 1_000_000
#: Windows of a piece at most; longer items are cut into pieces that overlap, so that each window is in one of them.
PIECE_WINDOWS = 20_000


class Index(NamedTuple):
    """Windows of items. ``shingle``, ``offset``, ``window``: an entry for each shingle of each window, by shingle."""

    items: list[str]
    item: np.ndarray  # of each window
    size: np.ndarray  # words of each window
    start: np.ndarray  # of each window in ``buf``, and its end
    end: np.ndarray
    buf: bytes  # words of the items, lower-cased, joined by spaces
    shingle: np.ndarray
    offset: np.ndarray
    window: np.ndarray

    def text(self, window: int) -> bytes:
        return self.buf[self.start[window] : self.end[window]]

    def prefixed(self, shingle: np.ndarray, count: np.ndarray) -> Index:
        """With the rarest shingle of each window only, by the counts of those that occur; ties go to the first."""
        order = np.argsort(shingle)
        shingle, count = shingle[order], count[order]
        rare = np.zeros(len(self.shingle), np.int64)
        if len(shingle):
            at = np.minimum(np.searchsorted(shingle, self.shingle), len(shingle) - 1)
            rare = np.where(shingle[at] == self.shingle, count[at], 0)
        by = np.lexsort((self.offset, rare, self.window))
        pick = by[np.append(True, self.window[by][1:] != self.window[by][:-1])[: len(by)]]
        pick = pick[np.argsort(self.shingle[pick], kind="stable")]
        return self._replace(shingle=self.shingle[pick], offset=self.offset[pick], window=self.window[pick])


def make_index(items: list[tuple[str, str]], window: int) -> Index:
    """An index of (id, text) items; items without words have no window."""
    buf, base, count = [], 0, 0
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in ("item", "size", "start", "end", "offset", "window")}
    shingles = [np.zeros(0, np.uint64)]
    for k, (_, text) in enumerate(items):
        for chunk in tb.chunks(pa.array([text], pa.string())):
            found = tb.words(chunk, tb.ALNUM_WORDS)
            n = len(found.start)
            if not n:
                continue
            size = min(window, n)
            step = min(SHINGLE, size)
            grams = tb.gram_hashes(tb.word_hashes(chunk, found), step)
            low = tb.FOLD[chunk.buf]
            buf.append(b" ".join(low[a:b].tobytes() for a, b in zip(found.start, found.end, strict=True)))
            end = np.cumsum(found.end - found.start + 1) - 1 + base
            start = end - (found.end - found.start)
            at, inner = np.arange(n - size + 1), np.arange(size - step + 1)
            for name, x in (("item", np.full(len(at), k)), ("size", np.full(len(at), size)), ("start", start[at]), ("end", end[at + size - 1]), ("offset", np.tile(inner, len(at))), ("window", np.repeat(at + count, len(inner)))):
                parts[name].append(x)
            shingles.append(grams[(at[:, None] + inner).ravel()])
            count += len(at)
            base += len(buf[-1])
    shingle = np.concatenate(shingles)
    by = np.argsort(shingle, kind="stable")
    whole = {k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}
    return Index([i for i, _ in items], whole["item"], whole["size"], whole["start"], whole["end"], b"".join(buf), shingle[by], whole["offset"][by], whole["window"][by])


def _pieces(window: int) -> object:
    """(item, piece, text, windows) of batches of (text, id): words joined by spaces, in pieces of PIECE_WINDOWS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(1).to_pylist(), []
            for chunk in tb.chunks(batch.column(0)):
                found = tb.words(chunk, tb.ALNUM_WORDS)
                for row in range(len(chunk.at) - 1):
                    a, b = int(found.at[row]), int(found.at[row + 1])
                    for piece, at in enumerate(range(a, b if b - a < window else b - window + 1, PIECE_WINDOWS)):
                        to = min(b, at + PIECE_WINDOWS + window - 1)
                        text = b" ".join(chunk.buf[x:y].tobytes() for x, y in zip(found.start[at:to], found.end[at:to], strict=True)).decode()
                        out.append({"item": ids[chunk.first + row] or "", "piece": piece, "text": text, "windows": max(1, to - at - window + 1)})
                        if b - a < window:
                            break
            yield pa.RecordBatch.from_pylist(out, pa.schema([("item", pa.string()), ("piece", pa.int64()), ("text", pa.string()), ("windows", pa.int64())]))

    return run


def indexes(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> Iterator[Index]:
    """The benchmark's indexes, one for each block, each built in a task; a block is bounded, and one at a time comes to the driver."""
    work = Tables(benchmark.sparkSession, "benchmark")
    pieces = work.keep("pieces", benchmark.select(F.coalesce(item_text, F.lit("")), F.col(item_id).cast("string")).mapInArrow(_pieces(window), "item string, piece bigint, text string, windows bigint"))
    blocks = -(-(pieces.agg(F.sum("windows")).first()[0] or 1) // BLOCK_WINDOWS)
    while True:
        block = F.pmod(F.xxhash64("item", "piece"), F.lit(blocks))
        most = pieces.groupBy(block.alias("block")).agg(F.sum("windows").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= BLOCK_WINDOWS or most <= PIECE_WINDOWS:
            break
        blocks *= 2

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "piece"])
        return pd.DataFrame({"packed": [pickle.dumps(make_index(list(zip(rows["item"], rows["text"], strict=True)), window))]})

    built = work.keep("built", pieces.withColumn("block", block).groupBy("block").applyInPandas(build, "packed binary"))
    for r in built.toLocalIterator():
        yield pickle.loads(bytes(r["packed"]))
    work.drop("pieces", "built")


def _hits(chunk: tb.Chunk, index: Index) -> tuple[tb.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's words; rows, word positions in the chunk and index entries of all shingle hits that stay inside a document."""
    found = tb.words(chunk, tb.ALNUM_WORDS)
    h = tb.word_hashes(chunk, found)
    rows, places, entries = [], [], []
    steps = np.minimum(index.size, SHINGLE)[index.window] if len(index.window) else np.zeros(0, np.int64)
    for step in np.unique(steps):
        grams = tb.gram_hashes(h, int(step))
        lo = np.searchsorted(index.shingle, grams, "left")
        near = np.flatnonzero((lo < len(index.shingle)) & (index.shingle[np.minimum(lo, len(index.shingle) - 1)] == grams))
        if not len(near):
            continue
        hi = np.searchsorted(index.shingle, grams[near], "right")
        many = hi - lo[near]
        place = np.repeat(near, many)
        entry = np.repeat(lo[near], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row = np.searchsorted(found.at, place, "right") - 1
        ok = (steps[entry] == step) & (place + step <= found.at[row + 1])
        rows.append(row[ok])
        places.append(place[ok])
        entries.append(entry[ok])
    if not rows:
        none = np.zeros(0, np.int64)
        return found, none, none, none
    return found, np.concatenate(rows), np.concatenate(places), np.concatenate(entries)


def _count_shingles(index_of) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_of()
        once, back = np.unique(index.shingle, return_inverse=True)
        total = np.zeros(len(once), np.int64)
        for batch in batches:
            for chunk in tb.chunks(batch.column(0)):
                _, _, place, entry = _hits(chunk, index)
                if len(place):
                    total += np.bincount(np.unique(np.stack([place, back[entry]]), axis=1)[1], minlength=len(once))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(once[seen].view(np.int64)), "n": pa.array(total[seen])})

    return run


#: What is found in a document. starts and ends: word positions (end exclusive) of the stretches that windows cover; items: ids, sorted as strings.
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _joined(parts: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _find(text_at: int, before_at: int | None, index_of, name: str) -> object:
    """Appends FOUND to each row; ``before_at``: a column of what earlier blocks found, which goes into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_of()
        for batch in batches:
            out = []
            for chunk in tb.chunks(batch.column(text_at)):
                found, rows, places, entries = _hits(chunk, index)
                start = places - index.offset[entries]
                window = index.window[entries]
                inside = (start >= found.at[rows]) & (start + index.size[window] <= found.at[rows + 1])
                spans: dict[int, list[list[int]]] = {}
                items: dict[int, set[str]] = {}
                for row, at, w in zip(rows[inside].tolist(), start[inside].tolist(), window[inside].tolist(), strict=True):
                    end = at + int(index.size[w])
                    spelled = b" ".join(tb.FOLD[chunk.buf[found.start[k] : found.end[k]]].tobytes() for k in range(at, end))
                    if spelled == index.text(w):
                        base = int(found.at[row])
                        spans.setdefault(row, []).append([at - base, end - base])
                        items.setdefault(row, set()).add(index.items[index.item[w]])
                for row in range(len(chunk.at) - 1):
                    out.append({"n_words": int(found.at[row + 1] - found.at[row]), "spans": spans.get(row, []), "items": items.get(row, set())})
            if before_at is not None:
                for x, y in zip(out, batch.column(before_at).to_pylist(), strict=True):
                    x["spans"] = x["spans"] + [[a, b] for a, b in zip(y["starts"], y["ends"], strict=True)]
                    x["items"] = x["items"] | set(y["items"])
            for x in out:
                spans = _joined(x.pop("spans"))
                x["starts"], x["ends"] = [a for a, _ in spans], [b for _, b in spans]
                x["n_hit"] = sum(b - a for a, b in spans)
                x["items"] = sorted(x["items"])
            names = [n for k, n in enumerate(batch.schema.names) if k != before_at]
            columns = [c for k, c in enumerate(batch.columns) if k != before_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _FOUND)], [*names, name])

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of what is found in each row (FOUND), and that column's name.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null texts have no words; items
    without words are in no document; equal items are found alike. An item without an id counts as the empty id. No document row is shuffled: each
    block of the benchmark (BLOCK_WINDOWS windows) is one pass for counts and one for hits.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    name = fresh(docs.columns, "found")
    work = Tables(spark, "found")
    rows, before = docs.select(*docs.columns), None
    none = make_index([], window)
    for index in indexes(benchmark, item_id, item_text, window):
        if before is not None:  # more than one block: what was found goes on with the rows
            rows = work.keep("rows", rows)
        sent = sc.broadcast(index)
        counts = docs.select(text).mapInArrow(_count_shingles(lambda sent=sent: sent.value), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
        prefixed = sc.broadcast(index.prefixed(counts["shingle"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy(np.int64)))
        rows, before = _with_found(rows, text, before, prefixed, name), name
    return (rows if before else _with_found(rows, text, None, sc.broadcast(none), name)), name


def _with_found(rows: DataFrame, text: str, before: str | None, index, name: str) -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name != before]
    return rows.mapInArrow(_find(rows.columns.index(text), None if before is None else rows.columns.index(before), lambda: index.value, name), T.StructType([*fields, T.StructField(name, FOUND)]))


def items_digest(items) -> F.Column:
    """Lower-case hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.concat_ws(",", items), 256)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    rows, name = find_benchmark(docs, benchmark, **options)
    return rows.filter(F.col(f"{name}.n_hit") == 0).select(*docs.columns)


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
