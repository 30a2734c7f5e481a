"""The pipeline and the queries of the corpus operators on the smallest tables."""

import collections
import hashlib
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshlark.llm import exactdup, mixing, neardup, quality, queries
from test_small import brute_found, brute_near, waterfill

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicate", "benchmark", "source", "sharding"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        if k < 3:
            assert out.exceptAll(docs).count() == 0
        if k == 1:  # one of each group stays, and it is a document of the input
            groups = neardup.near_groups(docs)
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in groups.filter("kept").select("doc_id").collect())
        if k == 4:
            assert out.select(*docs.columns).exceptAll(docs).count() == 0 and out.count() == docs.count()
        docs = out.cache()


def test_clean_documents_stay(spark):
    """Of labelled documents the quality stage keeps nearly all good ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = labels.filter("quality = 1 AND toxic = 0").join(docs, "doc_id")
    assert good.join(out, "doc_id", "left_semi").count() >= 0.97 * good.count()
    junk = labels.filter("quality = 0").join(docs, "doc_id")
    assert junk.join(out, "doc_id", "left_semi").count() <= 0.2 * junk.count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect())
    res = con.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[names.index(c)] for c in columns)) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    table = "pages" if name.startswith("op2") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_spread_join(spark):
    """Hot and other keys, and null ones, against a plain join."""
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1500, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"))
    table = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k != '3'")
    got = exactdup.keyed_join(rows, table, "k", "n", 3000, F.col("id"))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k", "left").select("id", "k", "n").collect()))


def brute_weights(rows, good):
    """Log of the ratio of the probabilities of each text, word by word and pair by pair, its own counts left out."""
    grams = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", t or "")]
        grams[i] = (w, [("same",) if a == b else (a, b) for a, b in zip(w, w[1:], strict=False)])
    out = {i: 0.0 if w else None for i, (w, _) in grams.items()}
    for kind in (0, 1):
        raw = collections.Counter(x for g in grams.values() for x in g[kind])
        target = collections.Counter(x for i, g in grams.items() if i in good for x in g[kind])
        share = sum(target.values()) / max(1, sum(raw.values()))
        for i, g in grams.items():
            for x, n in collections.Counter(g[kind]).items():
                t, r = target[x] - n * (i in good), raw[x] - n
                out[i] += n * math.log((max(t, 0) + quality.PRIOR) / (max(r, 0) * share + quality.PRIOR))
    return out


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """Good, bad, copied, nearly copied and leaking documents, nulls and an empty text; labels; a benchmark."""
    rng = random.Random(12)
    good, bad = [f"good{k}" for k in range(14)], [f"bad{k}" for k in range(6)]  # few enough for pairs not to share a bucket
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    item = text(good, 14)
    docs, labels = [], []
    for k in range(160):
        t = text(bad if k % 5 == 0 else good, rng.randrange(12, 60))
        if k % 16 == 3:
            t = f"{t} {item} {text(good, 4)}"
        docs.append((k, t, "en", f"s{k % 4}", len(t)))
        if k % 3 == 0 or k % 5 == 0:
            labels.append((k, int(k % 5 != 0), 0))
        if k % 8 == 1:
            docs.append((1000 + k, t, "en", f"s{k % 3}", len(t)))
        if k % 8 == 2:
            w = t.split()
            w[-1] = "changed"
            docs.append((2000 + k, " ".join(w), None, None, 0))
    docs += [(5000, None, None, None, None), (5001, "", "en", "s0", 0)]
    return docs, labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def planted_dir(spark, planted, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted"))
    docs, labels, items = planted
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def brute_selected(spark, docs, labels):
    """The ids that are drawn: the k largest of weight and Gumbel noise."""
    good = {i for i, q, t in labels if q == 1 and not t}
    weights = brute_weights([d[:2] for d in docs], good)
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string")
    u = {r[0]: r[1] for r in frame.select("doc_id", mixing.draw(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")), "quality")).collect()}
    known = sorted(weights[i] for i in good if weights.get(i) is not None)
    least = known[max(0, math.ceil(0.01 * len(known)) - 1)]
    k = sum(w is not None and w >= least for w in weights.values())
    keys = {i: w - math.log(-math.log(u[i] + 2.0**-54)) for i, w in weights.items() if w is not None}
    return weights, set(sorted(keys, key=keys.get, reverse=True)[:k])


def test_quality_against_brute_force(spark, planted, planted_dir):
    docs, labels, _ = planted
    weights, chosen = brute_selected(spark, docs, labels)
    for r in queries.op7_select_quality(spark, planted_dir).collect():
        w = weights[r["doc_id"]]
        assert r["log_weight"] is None if w is None else r["log_weight"] == pytest.approx(w, abs=1e-6)
        assert r["kept"] == (r["doc_id"] in chosen)


def test_pipeline_against_brute_force(spark, planted, planted_dir):
    """All stages in plain Python, row by row."""
    docs, labels, items = planted
    chosen = brute_selected(spark, docs, labels)[1]
    rows = [d for d in docs if d[0] in chosen]
    near = brute_near([d[:2] for d in rows])
    rows = [d for d in rows if near[d[0]][1] == d[0]]
    rows = [d for d in rows if not brute_found(d[1], items, 10)[1]]
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    sums = collections.Counter()
    for d in rows:
        sums[d[3]] += size(d)
    targets = waterfill(sums)
    want = []
    for d in rows:
        rate = targets[d[3]] / sums[d[3]]
        u = int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        want += [d] * (int(rate) + (u < rate - int(rate)))
    out = corpus_pipeline.run(spark, planted_dir)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(out.columns) == 7
    assert sorted(map(str, (tuple(r)[:5] for r in out.collect()))) == sorted(map(str, want))
    assert len(rows) < len(chosen) < len(docs)


def test_stages_with_nulls_and_no_rows(spark, planted_dir):
    """Every stage takes empty tables, nulls in all columns, repeated rows and columns with helper names."""
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, key string, id string, is_target string"
    some = spark.createDataFrame([(None, None, None, None, None, "a", "b", "c", "d")] * 2 + [(1, "good1 good2 good3 good4 good5 good6", "en", "s", 3, "e", "f", "g", "h")] * 2, kinds)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, some.limit(0), planted_dir).count() == 0
        out = stage(spark, some, planted_dir)
        assert out.columns[: len(some.columns)] == some.columns
        if k in (1, 2, 4):
            assert out.count() == 4
        assert out.filter("copy = 'e'").count() >= 1
