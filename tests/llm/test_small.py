"""Operators on small tables: nulls, blanks, ties, repeats, empty tables, clashing names; and against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshlark.llm import decontam, exactdup, fuse, hpylm, htmltext, langid, mixing, neardup, pii, quality, queries, shards
from meshlark.llm import textbytes as tb
from meshlark.llm.spread import keyed_join, scratch, tidy

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "a b c d e f g h i j k l", "en", "s0", 1), (2, "a b c d e f g h i j k l", "en", "s0", 1), (3, "A B c d e f g h i j k l x", "en", "s1", 1), (4, None, None, None, None), (5, "", "en", "s1", 0), (6, " \t\n ", "en", None, 3), (7, "tiny", "en", "s2", 4),
        (8, LONG, "en", "s0", len(LONG)), (9, LONG + " end", "en", "s2", len(LONG) + 4), (10, "ünï cödé ünï", "de", "s2", 12), (10, "ünï cödé ünï", "de", "s2", 12),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, names):
    return df.withColumns({n: F.lit("mine") for n in names})


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(hpylm, "LEAST_BUCKETS", 4)


# bytes


def test_words_match_the_patterns():
    texts = ["Ab c\td", "", None, "x", "é-ü 1a!", " lead trail ", "a\x0bb\x1cc\x85d\xa0e"]
    chunk = next(iter(tb.chunks(pa.array(texts))))
    for kind, pattern in ((tb.SPACED_WORDS, r"[^\x20\x09-\x0D]+"), (tb.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = tb.words(chunk, kind)
        got = [[chunk.buf[a:b].tobytes().decode() for a, b in zip(found.start[found.at[k] : found.at[k + 1]], found.end[found.at[k] : found.at[k + 1]], strict=True)] for k in range(len(texts))]
        want = [re.findall(pattern, t or "") if kind is tb.SPACED_WORDS else [m for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for t in texts]
        assert got == want


def test_hashes_depend_on_words_only():
    a, b = (next(iter(tb.chunks(pa.array([t])))) for t in ("xx Hello world", "hello  WORLD"))
    ha, hb = (tb.word_hashes(c, tb.words(c, tb.SPACED_WORDS)) for c in (a, b))
    assert list(ha[1:]) == list(hb) and len(set(ha)) == 3
    assert list(tb.gram_hashes(ha, 2))[1] == tb.gram_hashes(hb, 2)[0]


def test_chunks_hold_whole_rows():
    arr = pa.array(["x" * 50, None, "y" * 500, "", "z"])
    got = [(c.first, c.last) for c in tb.chunks(arr[1:], 60)]
    assert got[0][0] == 0 and got[-1][1] == 4 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


# mixing


def waterfill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in left) if left else 0
        more = {s for s in left if w[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in names}
        full |= more


def test_mixing(docs, empty):
    rated, n = mixing.rate_documents(clashing(docs, ["mix_size"]))
    rows = rated.collect()
    sizes = collections.Counter()
    for r in rows:
        assert r[n["size"]] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r[n["size"]]
    want = waterfill(sizes)
    for r in rows:
        assert r[n["source_size"]] == sizes[r["source"]] and abs(r[n["target"]] - want[r["source"]]) < 1e-6
        assert r[n["copies"]] <= 2 and r["mix_size"] == "mine"
    assert rated.collect() == rows
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.rate_documents(empty)[0].count() == 0


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    rated, n = mixing.rate_documents(df)
    for r in rated.groupBy("source").agg(F.sum(F.col(n["size"]) * F.col(n["copies"])).alias("taken"), F.first(n["target"]).alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.08


def test_many_sources_are_joined_salted(docs, monkeypatch):
    plain = sorted(map(str, mixing.rate_documents(docs)[0].collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.rate_documents(docs)[0].collect())) == plain


# HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a &amp; b<p>c  d\n e", "a & b c d e"),
        ("<html><body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>First <b>bold</b> text.<br>Second</p></article><footer>f</footer></body></html>", "T First bold text. Second"),
        ("<body><div class='sidebar'>side</div><div id=main>" + ("<p>" + "word " * 30 + "</p>") * 3 + "<div role=navigation><p>next</p></div></div><script>var x='</p>'</script>", ("word " * 90).strip()),
        ("<div><p>one</div><p>two <a href=x>three</a> four five six seven", "one two three four five six seven"),
    ],
)
def test_html(page, want):
    assert htmltext.main_text(page) == want


def test_html_keeps_the_main_text():
    """A teaser article does not replace a longer text, and a wrapper with a boilerplate word in its class stays."""
    story = "<p>" + "</p><p>".join(f"Sentence {k} of the long story is here. " * 10 for k in range(8)) + "</p>"
    teaser = "<article><p>" + "Read the other story now. " * 62 + "</p></article>"
    assert "Sentence 7 of" in htmltext.main_text(f"<body><div class=content>{story}</div>{teaser}</body>")
    two = htmltext.main_text(f"<body><div><article>{'first part ' * 60}</article><article>{'second part ' * 50}</article></div></body>")
    assert "first part" in two and "second part" in two
    links = "".join(f"<li><a href=/{k}>elsewhere {k}</a></li>" for k in range(12))
    wrapped = htmltext.main_text(f"<body><div class='content has-sidebar'>{story}<div class=sidebar><ul>{links}</ul></div></div></body>")
    assert "Sentence 7 of" in wrapped and "elsewhere" not in wrapped
    named = htmltext.main_text(f"<body><div>{story}<section class=related-work>{story.replace('long', 'related')}</section><section id=discussion>{story.replace('long', 'discussed')}</section></div><div class=ad>Buy this.</div></body>")
    assert "related story" in named and "discussed story" in named and "Buy" not in named


def test_densities_against_plain_sums():
    """Characters, tags, links and densities of random trees by recursion over the definition."""
    rng = random.Random(11)

    def tree(depth):
        return [rng.choice(["div", "p", "a", "span", "td"]), [rng.choice(["xy z", "words of text ", "q"]) if rng.random() < 0.5 or not depth else tree(depth - 1) for _ in range(rng.randrange(1, 4))]]

    def node(tag, parts):
        made = htmltext.Node(tag, None, False)
        made.parts = [p if isinstance(p, str) else node(*p) for p in parts]
        return made

    def sums(x):
        chars = tags = linked = links = 0
        for p in x.parts:
            if isinstance(p, str):
                chars += len(p.replace(" ", ""))
            else:
                c, t, lc, lt = sums(p)
                chars, tags = chars + c, tags + t + 1
                linked, links = (linked + c, links + lt + 1) if p.tag == "a" else (linked + lc, links + lt)
        return chars, tags, linked, links

    for _ in range(60):
        body = node("body", [tree(3) for _ in range(3)])
        root = htmltext.Node("html", None, False)
        root.parts = [body]
        c0, _, l0, _ = sums(body)
        density = {}
        for x in htmltext._measure(root):
            c, t, lc, lt = sums(x)
            assert (x.chars, x.tags, x.linked, x.links) == (c, t, lc, lt)
            base = math.log(c / max(1, c - lc) * lc + l0 / c0 * c + math.e)
            density[x] = c / max(1, t) * math.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1.0)) / math.log(base) if c and base > 1 + 1e-9 else c / max(1, t) * math.log(max(c * max(1, t), 1.0)) if c else 0.0
            assert x.density == pytest.approx(density[x])
        for x in density:
            assert x.total == pytest.approx(sum(density[p] for p in x.parts if not isinstance(p, str)))


def test_html_never_fails():
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<!--", "-->", "<", ">", "&amp;", "&#x;", "text ", "<a href=\"", "<script>", "</table>", "<li>", "<td>", "\x00", "ü"]
    for _ in range(300):
        assert isinstance(htmltext.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(40)))), str)
    assert htmltext.main_text("<div>" * 20_000 + "deep")  # no recursion


def test_html_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>hi", "y")], "page_id int, html string, main string")
    out, name = htmltext.extract(df)
    assert name != "main" and [r[name]["text"] for r in out.orderBy("page_id").collect()] == ["", "hi"]


# language


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(np.unique(np.array([langid._piece_hash(p) for p in (b"\x01", b"\x01a", b"a", b"b", b"ab", b"\x01ab")], np.uint64)), 3)
    probs = langid._normal(np.arange(1.0, 7.0)[:, None])
    p = {x: probs[np.searchsorted(pieces.hashes, np.uint64(langid._piece_hash(x))), 0] for x in (b"\x01", b"\x01a", b"a", b"b", b"ab", b"\x01ab")}
    want = p[b"\x01"] * p[b"a"] * p[b"b"] + p[b"\x01a"] * p[b"b"] + p[b"\x01"] * p[b"ab"] + p[b"\x01ab"]
    letters = np.frombuffer(b"\x01ab", np.uint8)[None, :]
    assert abs(np.exp(langid.forward(langid._lookup(pieces, letters), 3, 3, lambda x: probs[x])[-1, 0, 0]) - want) < 1e-15
    assert abs(np.exp(langid.backward(langid._lookup(pieces, letters), 3, 3, lambda x: probs[x])[0, 0, 0]) - want) < 1e-15


def test_long_words_are_read_whole():
    """A word of any length against sums in logarithms over all its pieces, by place; short ways and the long way agree."""
    pieces = langid.read_pieces()
    rng = np.random.default_rng(1)
    probs = langid._normal(rng.random((len(pieces.hashes), 3)) ** 8)
    for word in ("Donaudampfschifffahrtsgesellschaftskapitän" * 30, "\u4e2d\u6587\u6bb5\u843d" * 40, "a" * 700, "kapitän"):
        letters = np.frombuffer(b"\x01" + word.lower().encode(), np.uint8)
        size = len(letters)
        want = np.full((size + 1, 3), -np.inf)
        want[0] = 0
        for j in range(1, size + 1):
            for i in range(max(0, j - pieces.longest), j):
                at = np.searchsorted(pieces.hashes, np.uint64(langid._piece_hash(letters[i:j].tobytes())))
                if at < len(pieces.hashes) and pieces.hashes[at] == np.uint64(langid._piece_hash(letters[i:j].tobytes())):
                    want[j] = np.logaddexp(want[j], want[i] + np.log(probs[at]))
        for stretches in (langid._lookup(pieces, letters[None, :]), langid._lookup_long(pieces, letters)):
            assert np.allclose(langid.forward(stretches, size, pieces.longest, lambda x: probs[x])[:, 0], want, rtol=1e-9)
            assert np.allclose(langid.backward(stretches, size, pieces.longest, lambda x: probs[x])[0, 0], want[-1], rtol=1e-9)
    model = langid.Model(["x", "y", "z"], pieces, probs)
    text = pa.array(["Kapitän " + "Donaudampf" * 500])
    chunk = next(iter(tb.chunks(text)))
    found, row, _ = langid._words_of(chunk)
    assert len(found.start) == 2 and np.isfinite(langid.word_logs(model, chunk, found.start, found.end)).all()


def test_language_against_brute_force(spark):
    """The posterior of whole texts by plain sums over segmentations, with the learned probabilities."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund ist im haus", "de"), ("le chat est dans la maison", "fr")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    tests = [(100, "the haus"), (101, "Le Chat, 9 est"), (102, "hund"), (103, "12 --"), (104, None), (105, "maison" * 30)]
    out, name = langid.predict(spark.createDataFrame(tests, "doc_id bigint, text string"), model)
    for r in out.collect():
        logs = np.zeros(3)
        words = re.findall(r"[a-z]+", (r["text"] or "").lower())
        for w in words:
            letters = b"\x01" + w.encode()
            alpha = [np.zeros(3)]
            for j in range(1, len(letters) + 1):
                total = np.full(3, -np.inf)
                for i in range(j):
                    at = np.searchsorted(model.pieces.hashes, np.uint64(langid._piece_hash(letters[i:j])))
                    if at < len(model.pieces.hashes) and model.pieces.hashes[at] == np.uint64(langid._piece_hash(letters[i:j])):
                        total = np.logaddexp(total, alpha[i] + np.log(model.probs[at]))
                alpha.append(total)
            logs += alpha[-1]
        want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert r[name]["lang"] == (model.langs[int(want.argmax())] if words else None)
        assert r[name]["score"] == pytest.approx(want.max() if words else 0, abs=1e-9)


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 3 != 0"))
    rows, name = langid.predict(clashing(docs.filter("doc_id % 3 = 0"), ["language"]), model)
    got = [(r["lang"], r[name]) for r in rows.collect()]
    assert np.mean([x["lang"] == lang for lang, x in got]) > 0.97 and all(0 <= x["score"] <= 1 for _, x in got)


def test_language_edges(docs, empty):
    rows, name = langid.predict(docs, langid.fit(docs))
    said = {r["doc_id"]: r[name]["lang"] for r in rows.collect()}
    assert said[4] is None and said[5] is None and said[6] is None and said[10] == "de" and said[8] == "en"
    assert langid.predict(empty, langid.fit(empty))[0].count() == 0
    nothing, name = langid.predict(docs, langid.fit(empty))
    assert {r[name]["lang"] for r in nothing.collect()} == {None}


# near copies


def brute_near(rows):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, grams(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 75 * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_copies_against_all_pairs(spark, docs):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
        rows.append((1000 + k, " ".join(w[: rng.choice([len(w), len(w), len(w) - 1])])))
    rows.append((5000, "A b C"))
    rows.append((5001, "a B c"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)


def test_near_copies_that_share_a_passage(spark):
    """Many texts with one long passage, below the bound by pairs, and copies of some of them: all buckets stay open, and no link is lost."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(120):
        w = [f"u{rng.randrange(10**6)}" for _ in range(14)] + passage + [f"u{rng.randrange(10**6)}" for _ in range(14)]
        rows.append((k, " ".join(w)))
        if k % 10 == 0:
            w[rng.randrange(len(w))] = "changed"
            rows.append((1000 + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)


def test_near_copies_on_the_test_documents(spark):
    """Every component of sf0.01 against all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(df).collect()}
    assert got == brute_near([(r["doc_id"], r["text"]) for r in df.collect()])


def test_sketches_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(5)
    for n, m in ((10, 3), (300, 80), (3000, 900), (50, 5000)):
        common, one, two = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, m, m // 2))
        a, b = (neardup.parity(np.unique(np.concatenate([common, x]))) for x in (one, two))
        assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= m + m // 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            up[q] = p
    got = {r["id"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {x: got.get(x, x) for x in up} == {x: find(x) for x in up}


def test_near_copies_edges(docs, empty):
    assert neardup.near_groups(empty).count() == 0
    left = neardup.without_near_copies(clashing(docs, ["n", "digest"]))
    assert left.columns[:5] == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 4, 5, 6, 7, 8, 10, 10]


# benchmark


def brute_found(text, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, names = low(text), set(), set()
    for i, t in items:
        x = low(t)
        k = min(window, len(x))
        wins = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if k else set()
        for at in range(len(w) - k + 1) if k else ():
            if tuple(w[at : at + k]) in wins:
                hit |= set(range(at, at + k))
                names.add(str(i))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block", [500_000, 6])
def test_benchmark_against_all_windows(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontam, "PIECE_WINDOWS", min(block, 3))
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 6, 10, 14])))) for k in range(14)] + [(99, None), (98, "Ünï CÖdé"), (97, "A B C D E F G H I J")]
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(60)))) for k in range(60)] + [(100, "x " + items[3][1].upper() + "."), (101, None), (102, "ünï cödé"), (103, LONG)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    frame = clashing(spark.createDataFrame(rows, "doc_id int, text string"), ["found"])
    out, name = decontam.find_benchmark(frame, bench)
    for r in out.collect():
        assert (r[name]["n_words"], r[name]["n_hit"], r[name]["items"]) == brute_found(r["text"], items, 10)
        assert r["found"] == "mine"
    assert decontam.find_benchmark(docs, bench.limit(0))[0].count() == docs.count()
    assert decontam.without_benchmark(empty, bench).count() == 0


def test_blocks_count_windows_however_words_are_separated(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WINDOWS", 100)
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 300)
    text = "\n".join(f"w{k}" for k in range(2000))
    got = list(decontam.indexes(spark.createDataFrame([(1, text), (2, "a.b,c")], "item_id int, text string"), "item_id", "text", 10))
    assert sum(len(x.item) for x in got) == 1992 and max(len(x.item) for x in got) <= 300
    assert {x.text(k) for x in got for k in range(len(x.item))} == {" ".join(f"w{k}" for k in range(a, a + 10)).encode() for a in range(1991)} | {b"a b c"}


# language model


def lm_frame(**columns):
    return pd.DataFrame({k: [v] for k, v in columns.items()})


def test_probabilities_sum_to_one():
    """Of all known words and an unknown one, after a context that was seen, and after one that was not."""
    rng = np.random.default_rng(4)
    words, names = np.sort(rng.integers(1, 1 << 63, 30, dtype=np.uint64)), np.sort(rng.integers(1, 1 << 63, 8, dtype=np.uint64))
    known = np.arange(30) != 11  # word 11 is not in training, context 5 neither
    counts = np.where(known[:, None] & (np.arange(8) != 5), rng.integers(0, 6, (30, 8)) ** 3, 0)
    counts[3, 2] = 400
    word, context = np.nonzero(counts)
    base = {"bucket": 0, "n_words": 30, "n_pairs": len(word), "n_names": 8, "words": words.tobytes(), "names": names.tobytes(), "per_word": hpylm._small(np.bincount(word, minlength=30)), "contexts": hpylm._places(context, 8), "counts": hpylm._small(counts[word, context]), "customers": hpylm._small(counts.sum(axis=0)), "known": hpylm._small(counts.sum(axis=1))}
    totals, seen = hpylm.Totals(0, 0, int((counts.sum(axis=1) > 0).sum()), 0.6, 1.0, 0.8, 1.0), {}
    for k in range(3):
        state = base | {c: seen[f"{c}_0"] for c in ("n_tables", "tables", "root_customers", "root_tables") if seen}
        new = next(iter(hpylm._sweep(totals, k, int(counts.sum()), 0.3)(iter([lm_frame(**state)]))))
        of_word = hpylm._large(new["of_word"][0], 30)
        root = hpylm._seat_root(totals, k)(of_word, 0)
        totals = totals._replace(root_customers=int(of_word.sum()), root_tables=int(root.sum()))
        seen = {"n_tables_0": new["n_tables"][0], "tables_0": new["of_context"][0], "root_customers_0": hpylm._small(of_word), "root_tables_0": hpylm._small(root)}
    for at in (2, 5):
        asked = lm_frame(chunk="c", bucket=0, n_words=30, n_pairs=30, n_names=1, words=words.tobytes(), per_word=hpylm._small(np.ones(30)), names=names[at : at + 1].tobytes(), contexts=hpylm._places(np.zeros(30), 1), counts=hpylm._small(np.zeros(30)))
        out = hpylm._answer([totals])(asked, lm_frame(**base, **seen))
        logs = np.frombuffer(out["logs"][0], np.float32)
        assert (10.0**logs).sum() == pytest.approx(1, abs=1e-5) and list(hpylm._large(out["word_counts"][0], 30)) == list(counts.sum(axis=1))


def test_numbers_of_any_size_are_packed():
    x = np.array([0, 254, 255, 256, 1 << 32, 5_000_000_000, 1 << 60])
    assert list(hpylm._large(hpylm._small(x), len(x))) == list(x)
    for n in (10, 70_000, 1 << 33):
        at = np.array([0, min(n, 1 << 40) - 1])
        assert list(hpylm._from_places(hpylm._places(at, n), n)) == list(at)
    grid = hpylm.grid_of(1 << 50)
    h = np.array([0, (1 << 64) - 1], np.uint64)
    assert grid.size() > 1 << 26 and list(grid.of(h, h)) == [0, grid.size() - 1]


def test_a_chunk_of_many_documents(spark, monkeypatch):
    """More documents in a chunk than two bytes number."""
    monkeypatch.setattr(hpylm, "CHUNK_DOCS", 1 << 20)
    df = spark.range(70_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b").otherwise("c").alias("text")).coalesce(1)
    got = hpylm.score_documents(df, F.lit(False)).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("score").alias("d"), F.count_distinct("doc_id").alias("ids")).orderBy("n_tokens").collect()
    assert [tuple(r) for r in got] == [(2, 35_000, 1, 35_000), (3, 35_000, 1, 35_000)]


def plain_model(train, tests, discount, sweeps=300, seed=1):
    """Predictive log10 probabilities of texts by a sampler that moves one customer at a time and keeps whole tables."""
    rng = random.Random(seed)
    strength, root_discount, root_strength = 1.0, 0.8, 1.0
    tokens = [(c, w) for text in train for c, w in zip(["<s>", *text], [*text, "</s>"], strict=True)]
    vocabulary = {w for _, w in tokens}
    tables, root, at = {}, {}, [None] * len(tokens)  # of (context, word), of word: sizes

    def p_root(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        base = 1 / (2 * len(vocabulary)) if w in vocabulary else 0.5
        return (max(sum(root.get(w, [])) - root_discount * len(root.get(w, [])), 0) + (root_strength + root_discount * t) * base) / (root_strength + n)

    def p_word(c, w):
        mine = [(k, v) for k, v in tables.items() if k[0] == c]
        n, t = sum(sum(v) for _, v in mine), sum(len(v) for _, v in mine)
        own = tables.get((c, w), [])
        return (sum(own) - discount * len(own) + (strength + discount * t) * p_root(w)) / (strength + n)

    def sit(sizes, d, new):
        weights = [x - d for x in sizes] + [new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(sizes):
            sizes.append(0)
        sizes[k] += 1
        return k == len(sizes) - 1 and sizes[k] == 1

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    total = [0.0] * len(tests)
    kept = 0
    sums = [[0.0] * (len(t) + 1) for t in tests]
    for sweep in range(sweeps):
        for i, (c, w) in enumerate(tokens):
            if at[i]:
                if leave(tables[c, w]):
                    leave(root[w])
                if not tables[c, w]:
                    del tables[c, w]
            mine = sum(len(v) for k, v in tables.items() if k[0] == c)
            if sit(tables.setdefault((c, w), []), discount, (strength + discount * mine) * p_root(w)):
                t = sum(map(len, root.values()))
                sit(root.setdefault(w, []), root_discount, (root_strength + root_discount * t) / (2 * len(vocabulary)))
            at[i] = True
        if sweep >= 40:
            kept += 1
            for s, text in zip(sums, tests, strict=True):
                for k, (c, w) in enumerate(zip(["<s>", *text], [*text, "</s>"], strict=True)):
                    s[k] += p_word(c, w)
    return [sum(np.log10(x / kept) for x in s) for s in sums] if kept else total


def test_scores_against_a_plain_sampler(spark):
    rng = random.Random(4)
    train = [rng.choices("abcde", [8, 4, 2, 1, 1], k=rng.randrange(1, 7)) for _ in range(14)]
    tests = [list("ab"), list("eed"), list("xa"), [], list("aaaa")]
    rows = [(k, " ".join(t)) for k, t in enumerate(train)] + [(1000 + k, " ".join(t)) for k, t in enumerate(tests)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in hpylm.score_documents(df, F.col("doc_id") >= 1000, burn=2, samples=5).collect()}
    pairs = collections.Counter(x for t in train for x in zip(["<s>", *t], [*t, "</s>"], strict=True))
    discount = hpylm._discount(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
    for k, want in enumerate(plain_model(train, tests, discount)):
        assert got[1000 + k] == pytest.approx(want, abs=0.12 * (len(tests[k]) + 1))  # the noise of five samples


def test_contexts_are_not_mixed(spark):
    """Words whose hashes agree in the last 16 bits are different contexts; totals of a context are those of all buckets."""
    names = [f"c{k}" for k in range(2000)]
    chunk = next(iter(tb.chunks(pa.array([" ".join(names)]))))
    met = {}
    for name, h in zip(names, tb.word_hashes(chunk, tb.words(chunk, tb.SPACED_WORDS)), strict=True):
        met.setdefault(int(h) & 0xFFFF, []).append(name)
    a, b = next(x for x in met.values() if len(x) > 1)[:2]
    train = [(k, f"{a} left") for k in range(200)] + [(200 + k, f"{b} right") for k in range(200)]
    rows = train + [(1000, f"{a} left"), (1001, f"{a} right"), (1002, f"{b} left"), (1003, f"{b} right")]
    s = {r["doc_id"]: r["score"] for r in hpylm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") >= 1000).collect()}
    assert s[1000] > s[1001] + 1 and s[1003] > s[1002] + 1
    lists = {0: {1 << 60: 5, 1 << 63: 300}, 1: {1 << 60: 7, 3: 1}, 2: {1 << 63: 70_000}}
    packed = [(k, np.array(sorted(x), np.uint64).tobytes(), hpylm._small(np.array([x[n] for n in sorted(x)]))) for k, x in lists.items()]
    rows = hpylm.over_buckets(spark.createDataFrame(packed, "bucket int, names binary, totals binary"), 6, lambda total, shard: total // 2).collect()
    for c, want in (("totals", {0: [12, 70_300], 1: [1, 12], 2: [70_300]}), ("tables", {0: [6, 35_150], 1: [0, 6], 2: [35_150]})):
        assert {r["bucket"]: list(hpylm._large(bytes(r[c]), len(lists[r["bucket"]]))) for r in rows} == want
    assert [sum(r[c] for r in rows) for c in ("positive", "customers", "seated")] == [3, 70_313, 35_156]


def test_restaurants_are_normalised():
    """With counts and tables of one bucket: the parent and a context sum to one with the unknown word."""
    totals = hpylm.Totals(9, 5, 3, 0.7, 1.0, 0.8, 1.0)
    customers, tables = np.array([4, 3, 2]), np.array([2, 2, 1])
    parent = totals.root(customers, tables)
    assert parent.sum() + totals.unknown() == pytest.approx(1)
    c, t = np.array([6, 4, 0]), np.array([3, 1, 0])
    p = np.maximum(c - 0.7 * t, 0) / 11 + (1 + 0.7 * 4) / 11 * parent
    assert p.sum() + (1 + 0.7 * 4) / 11 * totals.unknown() == pytest.approx(1)


def test_sweeps_seat_every_customer():
    """Tables of dishes of thousands of customers against the exact distribution, and of small ones against single moves."""
    rng = np.random.default_rng(3)
    for c, d, w, g in ((3000, 0.6, 2.5, 0), (3000, 0.8, 40.0, 0), (5, 0.3, 0.7, 0), (3000, 0.6, 2.5, 0.3), (40, 0.5, 0.2, 0.45)):
        t = np.arange(min(c, 400) + 1)
        p = np.zeros(len(t), np.longdouble)  # w ** t S(c, t), scaled, by the recurrence
        p[1] = 1
        for j in range(1, c):
            p = p * np.maximum(j - d * t, 0) + np.append(0, (w + g * t[:-1]) * p[:-1])
            p /= p.sum()
        got = np.bincount(hpylm.draw_tables(np.full(20_000, c), d, np.full(20_000, w), rng, g), minlength=len(t)) / 20_000
        assert len(got) == len(t) and (got * t).sum() == pytest.approx((p * t).sum(), rel=0.01) and np.abs(np.cumsum(got) - np.cumsum(p)).max() < 0.02
    assert (hpylm.draw_tables(np.full(20_000, 2), 0.4, np.full(20_000, 0.3), rng) == 2).mean() == pytest.approx(0.3 / (0.3 + 1 - 0.4), abs=0.02)
    mixed = np.array([0, 1, 2, 700, 2, 65_000])
    tables = hpylm.draw_tables(mixed, 0.6, np.array([1.0, 1, 1e-9, 30, 1e9, 5]), rng)
    assert list(tables[[0, 1, 2, 4]]) == [0, 1, 1, 2] and (tables <= np.maximum(mixed, 0)).all()


def test_model_counts(docs, empty):
    rows = hpylm.score_documents(docs, F.col("doc_id") == 9).collect()
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    toks = [(r["doc_id"], pattern.findall((r["text"] or "").lower()) + [None]) for r in docs.collect()]
    count = collections.Counter(w for i, ws in toks if i != 9 for w in ws)
    total = sum(count.values())
    for r in rows:
        ws = next(ws for i, ws in toks if i == r["doc_id"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in ws))
    assert len(rows) == docs.count() and hpylm.score_documents(empty, F.lit(False)).count() == 0
    assert all(r["n_known"] == 0 for r in hpylm.score_documents(docs, F.lit(True)).collect())


# quality


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    good = [f"g{k}" for k in range(60)]
    bad = [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(good if k % 4 else bad) for _ in range(40))) for k in range(400)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), ["kept"])
    labels = spark.createDataFrame([(k, k % 4 != 0) for k in range(0, 400, 3)] + [(None, True), (3, None)], "doc_id bigint, good boolean")
    out, names = quality.select(df, labels)
    kept = {r["doc_id"]: r[names["kept"]] for r in out.collect()}
    assert np.mean([kept[k] for k in range(400) if k % 4]) > 0.95 and np.mean([kept[k] for k in range(400) if k % 4 == 0]) < 0.05
    assert {r["doc_id"]: r[names["kept"]] for r in out.collect()} == kept
    edge, names = quality.select(docs, labels)
    assert not any(r[names["kept"]] for r in edge.filter("doc_id in (4, 5, 6)").collect())
    assert quality.select(empty, labels)[0].count() == 0
    everyone, names = quality.select(docs, labels.limit(0))
    assert everyone.filter(names["kept"]).count() == 8


def test_kth_largest(spark):
    rng = random.Random(7)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 250, 500):
        assert quality.kth_largest(df, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]


# exact copies


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    packed = fuse.build(np.concatenate([keys, keys]))
    assert fuse.holds(packed, keys).all()
    others = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert fuse.holds(packed, others).mean() < 0.012
    assert n < 50_000 or len(packed) < 1.25 * n


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_copies(docs, empty, batches):
    rows = {}
    for r in exactdup.exact_groups(docs, batches).collect():
        rows.setdefault(r["doc_id"], r)
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    for text, ids in groups.items():
        for i in ids:
            assert tuple(rows[i]) == (i, max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert exactdup.exact_groups(empty, batches).count() == 0


def test_texts_that_share_a_digest_are_told_apart(docs, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exactdup.F, "sha2", lambda x, n: real(F.substring(x, 1, 0), n))  # all texts collide
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exactdup.exact_groups(docs).collect()}
    assert rows[1] == (2, 2) and rows[3] == (3, 1) and rows[4] == (5, 2) and rows[7] == (7, 1)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_the_screen_lets_all_repeated_digests_through(spark, bits):
    rows = exactdup.digest_rows(spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 350).cast("string")).alias("text")))
    repeated = exactdup.grouped(rows).filter("n > 1")
    through = exactdup.screen(rows, repeated, bits)
    assert through.columns == rows.columns and through.join(repeated, "sha", "left_semi").count() == 100
    assert through.count() == (100 if bits > 64 else through.count()) and through.count() <= 400


# shards


def test_shards(spark, docs, empty, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target=1 << 20)
    assert store.version() == 0 and store.shards() == []
    store.append(docs.repartition(4))
    before = store.shards()
    store.append(docs.repartition(4))
    assert store.version() == 2 and store.read(1).count() == docs.count() and len(before) == 4
    assert store.compact() > 2 and len(store.shards()) < 8
    both = docs.unionAll(docs)
    assert store.read().exceptAll(both).count() == 0 and both.exceptAll(store.read()).count() == 0
    with pytest.raises(shards.Conflict):
        store.commit([], ["data/none.parquet"])
    assert sum(s.rows for s in store.shards()) == 2 * docs.count()
    out, names, _ = shards.shard_documents(clashing(docs, ["shard"]), str(tmp_path / "t"))
    assert names["shard"] == "_shard" and out.drop(*names.values()).exceptAll(clashing(docs, ["shard"])).count() == 0
    assert shards.shard_documents(empty, str(tmp_path / "e"))[0].count() == 0


def test_writers_that_interleave_lose_nothing(spark, docs, tmp_path, monkeypatch):
    """Another writer commits at each step of a commit in turn."""
    one = shards.ShardStore(spark, str(tmp_path / "s"))
    two = shards.ShardStore(spark, str(tmp_path / "s"))
    one.append(docs)
    n = docs.count()
    for k, step in enumerate(("version", "shards", "_publish")):
        real, done = getattr(one, step), []

        def between(*args, real=real, done=done):
            early = real(*args) if step != "_publish" else None
            if not done:
                done.append(two.append(docs))
            return real(*args) if step == "_publish" else early

        monkeypatch.setattr(one, step, between)
        assert one.append(docs) == 3 + 2 * k and done == [2 + 2 * k]
        monkeypatch.undo()
        assert two.read().count() == (3 + 2 * k) * n and two.version() == 3 + 2 * k
    assert sorted(p.name for p in (tmp_path / "s" / "_manifests").iterdir() if p.suffix == ".json") == [f"v{k:08d}.json" for k in range(1, 8)]
    assert not [p for p in (tmp_path / "s" / "_manifests").iterdir() if p.suffix == ".tmp"]


def test_a_commit_that_fails_otherwise_raises(spark, docs, tmp_path, monkeypatch):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(docs)
    monkeypatch.setattr(store, "_at", lambda name, real=store._at: real(name.replace("_manifests/v", "_nowhere/v")))
    monkeypatch.setattr(store, "version", lambda: 0)
    with pytest.raises(Exception, match="NoSuchFile"):
        store.commit([])


def test_renames_do_not_overwrite(spark, docs, tmp_path, monkeypatch):
    """The way taken on file systems without links."""
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(docs)

    class Other:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda: "other") if name == "getScheme" else getattr(self.fs, name)

    monkeypatch.setattr(store, "_fs", Other(store._fs))
    versions = [0, 1, 1]
    monkeypatch.setattr(store, "version", lambda real=store.version: versions.pop(0) if versions else real())
    assert store.commit(store.shards(1)) == 2
    assert store.shards(2) == 2 * store.shards(1) and len(store.shards(1)) > 0


# personal data

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    def luhn(d):
        v = [int(c) for c in reversed(d)]
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(v)) % 10 == 0

    out = []
    for k, (kind, p) in enumerate((("email", E), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_pii_against_the_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "x.y@z-w.co.uk", "@", ".", "1.2.3.4", "256.1.1.1", "001.002.003.0255", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+49 30 1234567", " ", "ü", "😀", "_q@e.f", "12", "-", "+", "555", "  ", "a.b.", "%"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for k in range(1500)]
    rows += [(9001, None), (9002, ""), (9003, "1" * 5000), (9004, "1-" * 6000 + "1"), (9005, "a@b" + ".c" * 6000), (9006, "a" * 50_000), (9007, "x@y.z" * 300)]
    out, n = pii.find(clashing(spark.createDataFrame(rows, "doc_id int, text string"), ["pii_base"]))
    for r in out.select("doc_id", "text", pii.listed(F.col(n["base"])).alias("b")).collect():
        assert r["b"] == brute_pii(r["text"]), r["text"][:100]


def test_pii_terms(spark, empty):
    rows = [(k, f"please write to Zebulon Quartz at zq@corp.example.com about item {k} soon") for k in range(5)] + [(100 + k, f"please write about item {k} soon " + "word " * k) for k in range(80)]
    out, n = pii.find(spark.createDataFrame(rows, "doc_id int, text string"), letters=4)
    r = out.filter("doc_id = 1").first()
    assert [s["kind"] for s in r[n["spans"]]] == ["term", "term", "email"] and r[n["clean"]] == "please write to   at [email] about item 1 soon"
    assert out.filter(f"doc_id >= 100 AND size({n['spans']}) > 0").count() == 0
    assert pii.find(empty)[0].count() == 0


def test_pii_terms_far_away_and_short(spark, tmp_path):
    """The query weighs a name at the other end of the text, and one of two letters; common words stay."""
    far = "common words that fill the letter " * 12
    rows = [(k, f"from Wu Zebulon {far} item {k} zq@corp.example.com") for k in range(5)] + [(100 + k, f"from {far} item {k} " + "word " * k) for k in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in queries.op10_personal_data(spark, str(tmp_path)).collect()}
    end = len(rows[1][1])
    assert got[1] == f"term:5:7,term:8:15,email:{end - 19}:{end}" and not any(got[k] for k in got if k >= 100)


def test_tables_of_large_dishes():
    rng = np.random.default_rng(3)
    for d in (0.3, 0.8):
        logs = np.zeros(1)
        for c in range(1, 2500):
            t = np.arange(1, c + 1)
            new = np.full(c + 1, -np.inf)
            new[:c] = logs + np.log(c - d * t)
            new[1:] = np.logaddexp(new[1:], logs)
            logs = new
        t = np.arange(1, 2501)
        assert np.allclose(hpylm.log_ways(2500, t, d) + math.lgamma(2501), logs, rtol=0, atol=1e-7)
        for w, g in ((5.0, 0.01), (2000.0, 0.1)):
            p = logs + np.append(0, np.cumsum(np.log(w + g * t[:-1])))
            p = np.cumsum(np.exp(p - p.max()))
            got = hpylm.draw_tables(np.full(300, 2500), d, np.full(300, w), rng, g)
            assert np.abs((got[:, None] <= t).mean(axis=0) - p / p[-1]).max() < 0.11
    # no step for each customer: ten thousand million of them are drawn at once
    start = time.monotonic()
    some = hpylm.draw_tables(np.full(5, 10**10), 0.8, np.full(5, 1e5), rng, 0.05)
    assert time.monotonic() - start < 5 and (some > 1e5).all() and (some < 1e9).all()


def test_hashes_in_order_are_packed_as_gaps():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    x[[0, -1]] = 0, (1 << 64) - 1
    for part in (x, x[:0], x[:1], x[-1:]):
        assert list(hpylm._hashes(hpylm._gaps(part))) == list(part) == list(hpylm._hashes(part.tobytes()))
    assert len(zlib.compress(hpylm._gaps(x), 1)) < 0.9 * len(zlib.compress(x.tobytes(), 1))


def test_parts_of_the_model_leave_no_tables_and_no_shuffle_files(spark, monkeypatch):
    """Packed documents and models are deleted before the result is read, as are the shuffle files of each write; any number of parts gives the same counts."""
    ids = [None if k % 29 == 0 else k for k in range(200)]
    df = spark.createDataFrame([(i, " ".join(f"w{(k * n) % 17}" for n in range(k % 9))) for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(3)
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    setting, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(setting)
    for parts in (1, 2, 5):
        made = []
        monkeypatch.setattr(hpylm, "PARTS", parts)
        monkeypatch.setattr(hpylm, "scratch", lambda s, what: made.append(scratch(s, what)) or made[-1])
        out = hpylm.score_documents(df, F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False)))
        assert sorted(os.listdir(made[0].removeprefix("file:"))) == [f"scored{k}" for k in range(parts)]
        assert spark.conf.get(setting) == before
        seen.append(sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 4)) for r in out.collect()))
    assert len(seen[0]) == 200 and seen[0] == seen[1] == seen[2]
    was = files()
    with tidy(spark):
        spark.range(1000).repartition(8, "id").write.parquet(scratch(spark, "tidy"))
    assert files() <= was


def test_hot_keys_are_those_of_a_share_at_any_size(spark, monkeypatch):
    seen, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: seen.append(df.count()) or broadcast(df))
    for n in (50_000, 250_000):
        rows = spark.range(n).select("id", (F.col("id") % 1000).alias("k"))
        met = keyed_join(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n", n, F.col("id"))
        assert met.filter(F.col("n") == n // 1000).count() == n
    assert seen == [1000, 1000]


def plain_deep_model(train, tests, discounts, sweeps=400, seed=1):
    """As ``plain_model`` with contexts of two words under those of one: a restaurant's new tables are customers of its parent."""
    rng = random.Random(seed)
    steps = lambda text: zip(["<s>", "<s>", *text], ["<s>", *text], [*text, "</s>"], strict=False)
    tokens = [((2, a, b), w) for text in train for a, b, w in list(steps(text))[: len(text) + 1]]
    vocabulary, seats = {w for _, w in tokens}, collections.defaultdict(lambda: collections.defaultdict(list))
    parent = lambda c: (1, c[2]) if c[0] == 2 else (0,)
    discount = lambda c: discounts[c[0]]

    def chance(c, w):
        above = chance(parent(c), w) if c[0] else (1 / (2 * len(vocabulary)) if w in vocabulary else 0.5)
        here = seats[c]
        n, t = sum(map(sum, here.values())), sum(map(len, here.values()))
        own = here.get(w, [])
        return (sum(own) - discount(c) * len(own) + (1 + discount(c) * t) * above) / (1 + n)

    def sit(c, w):
        sizes, t = seats[c][w], sum(map(len, seats[c].values()))
        above = chance(parent(c), w) if c[0] else 1 / (2 * len(vocabulary))
        k = rng.choices(range(len(sizes) + 1), [x - discount(c) for x in sizes] + [(1 + discount(c) * t) * above])[0]
        if k < len(sizes):
            sizes[k] += 1
        else:
            sizes.append(1)
            if c[0]:
                sit(parent(c), w)

    def leave(c, w):
        sizes = seats[c][w]
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            if c[0]:
                leave(parent(c), w)

    sums = [[0.0] * (len(t) + 1) for t in tests]
    for sweep in range(sweeps):
        for c, w in tokens:
            if sweep:
                leave(c, w)
            sit(c, w)
        if sweep >= 50:
            for s, text in zip(sums, tests, strict=True):
                for k, (a, b, w) in enumerate(list(steps(text))[: len(text) + 1]):
                    s[k] += chance((2, a, b), w)
    return [sum(np.log10(x / (sweeps - 50)) for x in s) for s in sums]


def test_two_word_contexts_against_a_plain_sampler(spark, monkeypatch):
    rng = random.Random(5)
    train = [rng.choices("abcde", [8, 4, 2, 1, 1], k=rng.randrange(1, 7)) for _ in range(14)] + [list("abcabcabc")] * 3
    tests = [list("ab"), list("abca"), list("eed"), list("xa"), [], list("aaaa")]
    rows = [(k, " ".join(t)) for k, t in enumerate(train)] + [(1000 + k, " ".join(t)) for k, t in enumerate(tests)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(hpylm, "LEAST_BUCKETS", 4)
    got = {r["doc_id"]: r["score"] for r in hpylm.score_documents(df, F.col("doc_id") >= 1000, burn=3, samples=6, depth=2).collect()}
    triples = collections.Counter(x for t in train for x in zip(["<s>", "<s>", *t[:-1]], ["<s>", *t], [*t, "</s>"], strict=True))
    under = collections.Counter((b, w) for _, b, w in triples)
    estimate = lambda counts: hpylm._discount(sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values()))
    for k, want in enumerate(plain_deep_model(train, tests, {0: 0.8, 1: estimate(under), 2: estimate(triples)})):
        assert got[1000 + k] == pytest.approx(want, abs=0.12 * (len(tests[k]) + 1))


def test_probabilities_under_two_words_sum_to_one():
    """One bucket, from packing to answers: after any two words the chances of all words and one unknown times two."""

    class One:
        of, size = staticmethod(lambda word, context: np.zeros(len(word), np.uint64)), staticmethod(lambda: 1)

    rng = np.random.default_rng(8)
    vocabulary = np.unique(rng.integers(1, 1 << 62, 12).astype(np.uint64))
    chunker = hpylm.Chunker(One, 0, 0, 2)
    text = rng.choice(vocabulary, 3000, p=np.arange(1, 13) / 78)
    chunker.add(text, np.array([len(text)]), [1], np.array([False]))
    # then each word, and one that training has not, after each of some contexts
    unknown = np.uint64(77)
    contexts = [(text[0], text[1]), (vocabulary[0], vocabulary[1]), (unknown, vocabulary[3]), (vocabulary[2], unknown)]
    ends = [w for w in [*vocabulary, unknown]]
    for a, b in contexts:
        for w in ends:
            chunker.add(np.array([a, b, w], np.uint64), np.array([3]), [2], np.array([True]))
    head, asked = chunker.pack()
    asked = lm_frame(**asked[0])
    model = hpylm._count_deep(asked).iloc[0].to_dict()
    totals = hpylm.Totals(0, 0, 12, 0.6, 1.0, 0.8, 1.0, 0.7, 1.0)
    known = hpylm._large(model["known"], model["n_words"])
    for k in range(3):
        new = next(iter(hpylm._sweep_deep(totals, k, 3000, 0.1, 0.5)(iter([lm_frame(**model)])))).iloc[0]
        of_word = hpylm._large(new["of_word"], model["n_words"])
        root = hpylm._seat_root(totals, k)(of_word, 0)
        totals = totals._replace(root_customers=int(of_word.sum()), root_tables=int(root.sum()))
        seen = {"n_tables": new["n_tables"], "deep_tables": new["deep_tables"], "tables": new["of_context"], "under_tables": new["of_deep"], "members": new["of_members"], "root_customers": hpylm._small(of_word), "root_tables": hpylm._small(root)}
        model |= seen
        out = hpylm._answer_deep([totals])(asked, lm_frame(**{c: x for c, x in model.items() if c not in seen}, **{f"{c}_0": x for c, x in seen.items()}))
        logs = np.frombuffer(out["logs"][0], np.float32).astype(float)
        one, more = hpylm._asked_deep(next(asked.itertuples()))
        word, under = one.words[one.word_of()][more.pair_of()], more.under
        for a, b in contexts:
            here = under == hpylm._under(np.array([a]), np.array([b]))[0]
            chance = dict(zip(word[here], 10.0 ** logs[here], strict=True))
            assert len(chance) >= 13 and sum(chance[w] for w in ends) == pytest.approx(1, abs=1e-5)
    assert known.sum() == 3000


def test_operator_six_uses_two_words(spark, tmp_path):
    """The word after a word depends on the one before it."""
    texts = ["x a y", "z a w"] * 40
    rows = [(k, t) for k, t in enumerate(texts)] + [(5000, "x a y"), (5001, "x a w"), (5002, "z a w"), (5003, "z a y")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    s = {r["doc_id"]: r["score"] for r in queries.QUERIES["op6_language_model"](spark, str(tmp_path)).collect()}
    assert s[5000] > s[5001] + 0.5 and s[5002] > s[5003] + 0.5
