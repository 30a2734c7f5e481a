"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

Two small collections of HALVES half-keys of ROWS minhashes each are computed for a document; a table key is
a pair of one of either, so HALVES ** 2 tables cost 2 * HALVES * ROWS minhashes instead of HALVES ** 2 * 2 * ROWS.
Only half-keys that some other document shares are paired. Documents with equal sets are one class from the start.
Classes are first compared with one other member of their buckets, the one that most of their tables lead to; links join components.
That is repeated for buckets that still hold two components as long as it links enough of what it compares. Members of buckets that then
still hold two are all compared with members of other components, behind bounds that lose no link: of their sets, ordered by rarity, links
share a shingle of the first quarter (prefix filter, with its bound by position), set sizes are near, and parity sketches differ in no more bits than linked sets may.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm import textbytes as tb
from meshlark.llm.spread import BROADCAST_ROWS, Tables, fresh, keyed_join

SHINGLE = 5
#: Half-keys of each of the two collections, and minhashes of each half-key. At similarity 0.75 a pair is
#: missed with probability 2 * (1 - 0.75 ** ROWS) ** HALVES, about 2e-4; at 0.8 about 7e-6.
HALVES, ROWS = 24, 4
#: Bits of a set's parity sketch.
SKETCH_BITS = 1024
#: Rounds of comparisons with one chosen member go on while one in so many is a link.
FRUITFUL = 10
#: A pair is a link if LINK[1] * common >= LINK[0] * union.
LINK = (75, 100)

BITS = [f"o{k}" for k in range(SKETCH_BITS // 64)]

_rng = np.random.default_rng(20_240_501)
_A = (_rng.integers(0, 1 << 32, 2 * HALVES * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, 2 * HALVES * ROWS, dtype=np.uint64).astype(np.uint32)


def sets_of(chunk: tb.Chunk) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each document: five words each, or all words of a shorter text."""
    found = tb.words(chunk, tb.SPACED_WORDS)
    h = tb.word_hashes(chunk, found)
    grams = tb.gram_hashes(h, SHINGLE)
    out = []
    for a, b in zip(found.at[:-1].tolist(), found.at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(tb.sequence_hash(h[a:b]) if b > a else np.zeros(0, np.uint64))
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 2 * HALVES) keys; each half-key hashes ROWS minhashes and its place. Sets must not be empty."""
    flat = np.concatenate(sets)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    mins = np.empty((2 * HALVES * ROWS, len(sets)), np.uint64)
    h = np.empty_like(x)
    for k in range(len(mins)):
        np.multiply(x, _A[k], out=h)
        h += _B[k]
        mins[k] = np.minimum.reduceat(h, at)
    keys = np.empty((2 * HALVES, len(sets)), np.uint64)
    for k in range(2 * HALVES):
        keys[k] = tb.mix(tb.gram_hashes(mins[k * ROWS : (k + 1) * ROWS].T.ravel(), ROWS)[::ROWS] + np.uint64(k))
    return keys.T


def parity(s: np.ndarray) -> np.ndarray:
    """A set's parity sketch (Mitzenmacher, Pagh and Pham, 2014): each element flips a bit. Two sketches differ in no more bits than the sets in elements."""
    flips = np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, digest, u, v and BITS) of batches of (text, doc_id)."""
    for batch in batches:
        n, first, second, keys, odd = [], [], [], [], []
        for chunk in tb.chunks(batch.column(0)):
            sets = sets_of(chunk)
            n += [len(s) for s in sets]
            odd += [parity(s) for s in sets]
            first += [int(np.add.reduce(tb.mix(s), dtype=np.uint64)) for s in sets]
            second += [int(np.bitwise_xor.reduce(tb.mix(s + np.uint64(7)))) if len(s) else 0 for s in sets]
            block = np.zeros((len(sets), 2 * HALVES), np.uint64)
            full = [k for k, s in enumerate(sets) if len(s)]
            if full:
                block[full] = half_keys([sets[k] for k in full])
            keys.append(block)
        both = np.concatenate(keys).view(np.int64) if keys else np.zeros((0, 2 * HALVES), np.int64)
        digest = [f"{k}-{a:016x}{b:016x}" if k else None for k, a, b in zip(n, first, second, strict=True)]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), HALVES).cast(pa.list_(pa.int64())) for part in (both[:, :HALVES], both[:, HALVES:])]
        bits = [pa.array(np.array([x[k] for x in odd], np.int64)) for k in range(len(BITS))]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.string()), *lists, *bits], ["doc_id", "n", "digest", "u", "v", *BITS])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, set) of batches of (text, id)."""
    for batch in batches:
        sets = [s.tobytes() for chunk in tb.chunks(batch.column(0)) for s in sets_of(chunk)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], ["id", "set"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) for each shingle of batches of (id, set)."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        if sets:
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(sets))], ["id", "key"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, common, union) of batches of (a, b, set_a, set_b)."""
    for batch in batches:
        common, union = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            c = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
            common.append(c)
            union.append(len(p) + len(q) - c)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "union"])


def compared(pairs: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """``pairs`` (a, b) with common and union of their full sets. ``few``: the pairs' rows were counted and may be broadcast.

    The last join is on the plain key ``a``, so that Spark can split a leader with many pairs.
    """
    small = F.broadcast if few else lambda df: df
    one = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")).join(small(pairs), "b")
    two = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")).join(small(pairs.select("a").distinct()), "a", "left_semi")
    kind = pairs.schema["a"].dataType.simpleString()
    return one.join(two, "a").select("a", "b", "set_a", "set_b").mapInArrow(_common, f"a {kind}, b {kind}, common bigint, union bigint")


def components(links: DataFrame, work: Tables | None = None) -> DataFrame:
    """(id, comp): the smallest id that the links (a, b) connect each id with; ids of links only.

    In a round every node that has a larger neighbour hooks to the largest, trees are flattened by pointer jumping, and links are
    moved to the roots. A root that no neighbour hooked to has a larger neighbour in the next round, so O(log n) rounds do.
    """
    work = work or Tables(links.sparkSession, "components")
    edges = work.keep("edges", links.select("a", "b").filter("a != b").distinct())
    labels = None
    while n := edges.count():
        small = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
        hooks = work.keep("hooks", edges.groupBy(F.least("a", "b").alias("id")).agg(F.max(F.greatest("a", "b")).alias("comp")))
        while True:
            over = small(hooks.select(F.col("id").alias("comp"), F.col("comp").alias("root")))
            jumped = hooks.join(over, "comp", "left")
            if jumped.filter("root is not null").isEmpty():
                break
            hooks = work.keep("hooks", jumped.select("id", F.coalesce("root", "comp").alias("comp")))
        over = small(hooks.toDF("old", "root"))
        moved = edges.join(over, F.col("a") == F.col("old"), "left").select(F.coalesce("root", "a").alias("a"), "b")
        moved = moved.join(over, F.col("b") == F.col("old"), "left").select("a", F.coalesce("root", "b").alias("b")).filter("a != b").distinct()
        edges = work.keep("edges", moved)
        if labels is not None:
            hooks = hooks.unionByName(labels.join(over, F.col("comp") == F.col("old"), "left").select("id", F.coalesce("root", "comp").alias("comp")))
        labels = work.keep("labels", hooks)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    least = labels.groupBy("comp").agg(F.least(F.min("id"), F.col("comp")).alias("least"))
    every = labels.unionByName(labels.select(F.col("comp").alias("id"), "comp").distinct())
    least = F.broadcast(least) if labels.count() <= BROADCAST_ROWS else least
    return every.join(least, "comp").select("id", F.col("least").alias("comp"))


def _fits(one: str, two: str):
    """Set sizes that allow a link."""
    return F.least(one, two) * LINK[1] >= F.greatest(one, two) * LINK[0]


def _may_link():
    """Whether sketches allow a link of two rows, the other's columns beginning with l.

    Links have a symmetric difference of at most (1 - t) / (1 + t) of the sizes' sum, and sketches differ in no more bits than that.
    """
    differ = None
    for c in BITS:
        n = F.bit_count(F.col(c).bitwiseXOR(F.col("l" + c)))
        differ = n if differ is None else differ + n
    return differ * (LINK[1] + LINK[0]) <= (F.col("n") + F.col("ln")) * (LINK[1] - LINK[0])


def link_classes(reps: DataFrame, docs: DataFrame, doc_id: str, text: str, work: Tables) -> DataFrame:
    """(id, comp) of the linked among ``reps`` (id, n, u, v, BITS), whose texts ``docs`` has."""
    # half-keys tell by their hash which they are; those of one document only are left out
    each = reps.select("id", "n", F.explode(F.concat(F.transform("u", lambda k: F.struct(F.lit(True).alias("first"), k.alias("key"))), F.transform("v", lambda k: F.struct(F.lit(False).alias("first"), k.alias("key"))))).alias("h")).select("id", "n", "h.*")
    met = work.keep("met", each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    shared = keyed_join(each, met, "key", "m", max(1, reps.count()), F.col("id")).filter("m is not null")
    sided = lambda first: F.collect_list(F.when(F.col("first") == first, F.col("key")))
    halves = shared.groupBy("id").agg(F.any_value("n").alias("n"), F.sum("m").alias("met"), sided(True).alias("keys"), sided(False).alias("others"))
    halves = work.keep("halves", halves.filter("size(keys) > 0 and size(others) > 0"))
    total = halves.count()

    def tables(rows: DataFrame, *columns: str) -> DataFrame:
        """A row for each table key of a document."""
        one = rows.select("id", *columns, F.explode("keys").alias("ku"), "others")
        return one.select("id", *columns, "ku", F.explode("others").alias("kv")).select("id", *columns, F.xxhash64("ku", "kv").alias("key"))

    lead = tables(halves, "n", "met").groupBy("key").agg(F.max(F.struct("met", "id", "n")).alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    lead = work.keep("lead", lead.select("key", "size", F.col("l.id").alias("lid"), F.col("l.n").alias("ln")))
    meets = keyed_join(tables(halves, "n"), lead, "key", "size", total, F.col("id")).filter("size is not null")
    other = F.when((F.col("id") != F.col("lid")) & _fits("n", "ln"), F.col("lid"))
    met = work.keep("chosen", meets.groupBy("id").agg(F.mode(other, True).alias("lid")))
    some = met.select("id")
    few = met.count() <= BROADCAST_ROWS
    kind = reps.schema["id"].dataType.simpleString()
    wanted = docs.select(text, F.col(doc_id).alias("id")).join(F.broadcast(some) if few else some, "id", "left_semi").select(text, "id")
    sets = work.keep("sets", wanted.mapInArrow(_set_rows, f"id {kind}, set binary"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b), a table of its own."""
        got = compared(pairs, sets, pairs.count() <= BROADCAST_ROWS)
        return work.keep("links", got.filter(F.col("common") * LINK[1] >= F.col("union") * LINK[0]).select("a", "b"))

    comps = work.keep("comps", components(linked(work.keep("pairs", met.filter("lid is not null").select(F.col("lid").alias("a"), F.col("id").alias("b")))), work))

    def joined_by(links: DataFrame) -> DataFrame:
        """Components after more links: they join components, not documents."""
        over = F.broadcast(comps) if comps.count() <= BROADCAST_ROWS else comps
        ends = links.join(over.toDF("a", "ca"), "a", "left").join(over.toDF("b", "cb"), "b", "left")
        new = work.keep("joined", components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), work).toDF("old", "new"))
        over = F.broadcast(new) if new.count() <= BROADCAST_ROWS else new
        moved = comps.join(over, F.col("comp") == F.col("old"), "left").select("id", F.coalesce("new", "comp").alias("comp"))
        return work.keep("comps", moved.unionByName(new.join(comps, F.col("old") == F.col("id"), "left_anti").toDF("id", "comp")))

    def still_open(rows: DataFrame) -> DataFrame:
        """Table keys (key, id, n, met, comp) of buckets that hold two components, with ``major``, the largest of them, ``outside``, members of others, and ``size``."""
        sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        state = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("l"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        state = work.keep("state", state.select("key", "size", F.col("l.comp").alias("major"), (F.col("size") - F.col("l.c")).alias("outside")))
        return work.keep("open", keyed_join(rows, state, "key", "size", total, F.col("id")).filter("size is not null"))

    def with_comps(rows: DataFrame) -> DataFrame:
        over = F.broadcast(comps) if comps.count() <= BROADCAST_ROWS else comps
        return rows.drop("comp").join(over, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    rows, k = still_open(tables(with_comps(halves.join(F.broadcast(some) if few else some, "id", "left_semi")), "n", "met", "comp")), 0
    while not rows.isEmpty():
        # a leader of a bucket's largest component meets the others, each of which meets one leader: the commonest of its buckets
        best = F.struct("met", "id", "n") if not k else F.struct(F.xxhash64("id", F.lit(k)), "id", "n")
        lead = rows.filter("comp = major").groupBy("key").agg(F.max(best).alias("l"), F.any_value("size").alias("size"))
        lead = work.keep("lead", lead.select("key", "size", F.col("l.id").alias("lid"), F.col("l.n").alias("ln")))
        meets = keyed_join(rows.filter("comp != major").select("id", "n", "key"), lead, "key", "size", total, F.col("id")).filter(_fits("n", "ln"))
        pairs = work.keep("pairs", meets.groupBy("id").agg(F.mode("lid", True).alias("lid")).select(F.col("lid").alias("a"), F.col("id").alias("b")))
        links = linked(pairs)
        if found := links.count():
            comps = joined_by(links)
            rows = still_open(with_comps(rows).select("id", "n", "met", "key", "comp"))
        if found * FRUITFUL < pairs.count():
            break
        k += 1
    # what is open now meets on shingles of its prefixes only: those common to many documents come last in every set
    left = rows.select("id").distinct()
    left = work.keep("left", left)
    each = sets.join(F.broadcast(left) if left.count() <= BROADCAST_ROWS else left, "id", "left_semi").select("id", "set").mapInArrow(_shingles, f"id {kind}, key bigint")
    held = work.keep("held", each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    ranked = keyed_join(each, held, "key", "df", max(1, 64 * total), F.col("id")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "key"))).alias("s"))
    needed = F.floor((F.size("s") * LINK[0] + LINK[1] - 1) / LINK[1]).cast("int")
    sketches = reps.select("id", "n", *BITS).join(F.broadcast(left) if left.count() <= BROADCAST_ROWS else left, "id", "left_semi")
    prefix = ranked.join(sketches, "id").select("id", "n", *BITS, F.posexplode(F.slice("s", F.lit(1), F.size("s") - needed + 1)).alias("at", "p")).filter("p.df > 1").select("id", "n", *BITS, "at", F.col("p.key").alias("key"))
    rows = still_open(with_comps(work.keep("prefix", prefix)))
    # of any two components one is outside a bucket's largest; a bucket is dealt out by such members
    slots = F.ceil(F.col("outside") / 64).cast("int")
    slot = F.pmod(F.xxhash64("id"), slots).cast("int")
    # at the first shingle that links have in common, so many more must follow in both
    ahead = F.least(F.col("n") - F.col("at"), F.col("ln") - F.col("lat")) * (LINK[0] + LINK[1]) >= (F.col("n") + F.col("ln")) * LINK[0]
    outer = rows.filter("comp != major").select("key", slot.alias("slot"), F.col("id").alias("lid"), F.col("n").alias("ln"), F.col("comp").alias("lc"), F.col("at").alias("lat"), *[F.col(c).alias("l" + c) for c in BITS])
    inner = rows.select("key", "id", "n", "comp", "at", *BITS, F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    near = inner.join(outer, (inner["key"] == outer["key"]) & (inner["slot"] == outer["slot"]) & (F.col("comp") != F.col("lc")) & _fits("n", "ln") & ahead & _may_link())
    near = near.select(F.least("id", "lid").alias("a"), F.greatest("id", "lid").alias("b")).distinct()
    links = linked(work.keep("pairs", near))
    return comps if links.isEmpty() else joined_by(links)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. The smallest id of a component stays. Null, empty and blank texts have
    no shingles and are linked with nothing, nor are rows without an id; repeated rows are one document and all say the same. An empty
    table gives an empty result. Tables that the result does not read are deleted on the way.
    """
    work = Tables(docs.sparkSession, "near")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(text, F.col(doc_id).alias("doc_id")).mapInArrow(_sketch, f"doc_id {kind}, n bigint, digest string, u array<bigint>, v array<bigint>, " + ", ".join(f"{c} bigint" for c in BITS))
    rows = work.keep("sketched", rows)
    total = rows.count()
    heads = rows.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("id"), "n", "u", "v", *BITS)).alias("r"), F.count(F.lit(1)).alias("m"))
    classes = work.keep("classes", heads.select("digest", "m", "r.*"))
    comps = link_classes(classes.filter("id is not null").select("id", "n", "u", "v", *BITS), docs, doc_id, text, work)
    few = comps.count() <= BROADCAST_ROWS
    table = classes.select("digest", "m", "id").join(F.broadcast(comps) if few else comps, "id", "left")
    table = work.keep("table", table.select("digest", F.coalesce("comp", "id").alias("component_id"), "m").filter("m > 1 or comp is not null"))
    slim = work.keep("slim", rows.select("doc_id", F.col("n").alias("n_shingles"), "digest"))
    work.drop("sketched", "classes", "met", "halves", "lead", "chosen", "sets", "pairs", "links", "comps", "joined", "state", "open", "left", "held", "prefix", "edges", "hooks", "labels")
    out = keyed_join(slim, table, "digest", "m", total, F.col("doc_id"))
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those rows of which another in their component has a smaller id.

    Rows that repeat an id stay with it: they are one document.
    """
    name = fresh(docs.columns, "away")
    away = near_groups(docs, doc_id, text).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(away, F.col(doc_id) == F.col(name), "left_anti")
