"""Language identification by unigram pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary, learned by
expectation maximisation. A word's likelihood is the sum over all its segmentations into pieces, by
the forward algorithm; a text's is the product over its words. Single bytes are always pieces, so every
word has a segmentation.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm import textbytes as tb
from meshlark.llm.mixing import draw
from meshlark.llm.spread import fresh, kept

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language that the model is learned from, about (chosen by a hash of the id).
SAMPLE_DOCS = 3000
ROUNDS = 2
#: Words of more bytes are read one by one, shorter ones with all others of their length.
LONG = 64
#: Places between rescalings, so that no product underflows.
RESCALE = 8
#: Words whose likelihoods a task remembers.
REMEMBER = 300_000
#: Stands before a word's first letter, as the vocabulary's mark of a word's start does.
_MARK = 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces(NamedTuple):
    """The vocabulary by hash; ``longest``: bytes of the longest piece."""

    hashes: np.ndarray
    longest: int


def _piece_hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_FACTOR) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def read_pieces(path: str = VOCABULARY) -> Pieces:
    """Pieces of a public SentencePiece vocabulary, lower-cased, with the 256 single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            piece = model.id_to_piece(k).lower().encode().replace("▁".encode(), bytes([_MARK]))
            if piece and all(tb.LETTER_WORDS[b] for b in piece.removeprefix(bytes([_MARK]))):  # others are in no word
                found.add(piece)
    hashes = np.unique(np.array([_piece_hash(p) for p in found], np.uint64))
    return Pieces(hashes, max(map(len, found)))


def _lookup(pieces: Pieces, letters: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """For words of one length (a row of bytes each): start, end and piece of every stretch that is a piece of some word, -1 where it is none."""
    n, size = letters.shape
    out = []
    for i in range(size):
        h = np.zeros(n, np.uint64)
        for j in range(i + 1, min(size, i + pieces.longest) + 1):
            h = h * _FACTOR + letters[:, j - 1].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(pieces.hashes, h), len(pieces.hashes) - 1)
            hit = pieces.hashes[at] == h
            if hit.any():
                out.append((i, j, np.where(hit, at, -1)))
    return out


class Stretches(NamedTuple):
    """What ``_lookup`` gives, for one long word: entries by start and end."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for k, (i, j) in enumerate(zip(self.start, self.end, strict=True)):
            yield int(i), int(j), self.piece[k : k + 1]

    def __reversed__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for k in range(len(self.start) - 1, -1, -1):
            yield int(self.start[k]), int(self.end[k]), self.piece[k : k + 1]


def _lookup_long(pieces: Pieces, letters: np.ndarray) -> Stretches:
    """``_lookup`` of one word, for all its places at once."""
    starts, ends, found = [], [], []
    h = np.zeros(len(letters), np.uint64)
    for n in range(1, min(len(letters), pieces.longest) + 1):
        h = h[: len(letters) - n + 1] * _FACTOR + letters[n - 1 :].astype(np.uint64) + np.uint64(1)
        at = np.minimum(np.searchsorted(pieces.hashes, h), len(pieces.hashes) - 1)
        hit = np.flatnonzero(pieces.hashes[at] == h)
        starts.append(hit)
        ends.append(hit + n)
        found.append(at[hit])
    start, end, piece = (np.concatenate(x) for x in (starts, ends, found))
    order = np.lexsort((end, start))
    return Stretches(start[order], end[order], piece[order])


def forward(stretches, size: int, longest: int, probs_of) -> np.ndarray:
    """Logs of the summed probability of all segmentations of the first ``place`` bytes: [place, ...]. ``probs_of``: probabilities of an array of pieces.

    ``stretches`` are by start, and single bytes are pieces, so every place is reached. Sums are kept near one: what lies ahead of a place is rescaled together.
    """
    out = scale = alpha = None
    last = -1
    for i, j, piece in stretches:
        p = probs_of(piece)
        if alpha is None:
            alpha, scale = np.zeros((size + 1, *p.shape)), np.zeros(p.shape)
            out = np.zeros_like(alpha)
            alpha[0] = 1.0
        if i != last:
            last = i
            if i % RESCALE == 0:
                ahead = alpha[i : i + longest]
                most = ahead.max(axis=0)
                ahead /= most
                scale = scale + np.log(most)
            out[i] = np.log(alpha[i]) + scale
        alpha[j] += alpha[i] * p
    out[size] = np.log(alpha[size]) + scale
    return out


def backward(stretches, size: int, longest: int, probs_of) -> np.ndarray:
    """Logs of the summed probability of all segmentations of the bytes from ``place`` on."""
    out = scale = beta = None
    here = size
    for i, j, piece in reversed(stretches):
        p = probs_of(piece)
        if beta is None:
            beta, scale = np.zeros((size + 1, *p.shape)), np.zeros(p.shape)
            out = np.zeros_like(beta)
            beta[size] = 1.0
        if i != here:
            if here < size:
                out[here] = np.log(beta[here]) + scale
                if here % RESCALE == 0:
                    ahead = beta[here : here + longest]
                    most = ahead.max(axis=0)
                    ahead /= most
                    scale = scale + np.log(most)
            here = i
        beta[i] += beta[j] * p
    out[here] = np.log(beta[here]) + scale
    return out


def _words_of(chunk: tb.Chunk) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Letter runs, the row of each and its hash."""
    found = tb.words(chunk, tb.LETTER_WORDS)
    return found, np.repeat(np.arange(len(chunk.at) - 1), np.diff(found.at)), tb.word_hashes(chunk, found)


def _parts(size: int, n: int) -> Iterator[slice]:
    """Slices of ``n`` words of one size that are handled at once."""
    step = 1 if size > LONG else max(1, 1_000_000 // (size + 2))
    return (slice(k, k + step) for k in range(0, n, step))


def _stretches(pieces: Pieces, letters: np.ndarray):
    return _lookup_long(pieces, letters[0]) if letters.shape[1] > LONG + 1 else _lookup(pieces, letters)


def _by_length(chunk: tb.Chunk, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and lower-cased letters, after the mark, of words of each length."""
    low = tb.FOLD[chunk.buf]
    size = end - start
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        letters = np.empty((len(which), n + 1), np.uint8)
        letters[:, 0] = _MARK
        letters[:, 1:] = low[start[which][:, None] + np.arange(n)]
        yield which, letters


class Model(NamedTuple):
    langs: list[str]
    pieces: Pieces
    probs: np.ndarray  # of each piece (and a row of zeros) in each language


def word_logs(model: Model, chunk: tb.Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language."""
    out = np.zeros((len(start), len(model.langs)))
    for which, letters in _by_length(chunk, start, end):
        size = letters.shape[1]
        for part in _parts(size - 1, len(which)):
            out[which[part]] = forward(_stretches(model.pieces, letters[part]), size, model.pieces.longest, lambda piece: model.probs[piece])[-1]
    return out


def _score(text_at: int, model_of, name: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of()
        known, logs = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))
        for batch in batches:
            total = np.zeros((batch.num_rows, len(model.langs)))
            count = np.zeros(batch.num_rows, np.int64)
            for chunk in tb.chunks(batch.column(text_at)):
                found, row, h = _words_of(chunk)
                if not len(h):
                    continue
                once, first, back = np.unique(h, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, once), max(len(known) - 1, 0))
                new = known[at] != once if len(known) else np.ones(len(once), bool)
                mine = np.empty((len(once), len(model.langs)))
                if len(known):
                    mine[~new] = logs[at[~new]]
                if new.any():
                    mine[new] = word_logs(model, chunk, found.start[first[new]], found.end[first[new]])
                    if len(known) + new.sum() > REMEMBER:
                        known, logs = once, mine
                    else:
                        both = np.concatenate([known, once[new]])
                        by = np.argsort(both)
                        known, logs = both[by], np.concatenate([logs, mine[new]])[by]
                n = len(chunk.at) - 1
                for k in range(len(model.langs)):
                    total[chunk.first : chunk.last, k] += np.bincount(row, mine[back, k], n)
                count[chunk.first : chunk.last] += np.bincount(row, minlength=n)
            best = total.argmax(axis=1) if len(model.langs) else np.zeros(batch.num_rows, int)
            top = np.exp(total - total.max(axis=1, keepdims=True)) if len(model.langs) else total
            score = 1.0 / top.sum(axis=1) if len(model.langs) else np.zeros(batch.num_rows)
            none = count == 0
            lang = [None if x or not model.langs else model.langs[b] for x, b in zip(none, best, strict=True)]
            said = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score), pa.float64())], ["lang", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, said], [*batch.schema.names, name])

    return run


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch of (text, lang)."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        total: dict[tuple[str, bytes], int] = {}
        for chunk in tb.chunks(batch.column(0)):
            found, row, _ = _words_of(chunk)
            low = tb.FOLD[chunk.buf]
            for r, a, b in zip(row.tolist(), found.start.tolist(), found.end.tolist(), strict=True):
                key = (langs[chunk.first + r], low[a:b].tobytes())
                total[key] = total.get(key, 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in total], pa.string()), "word": pa.array([w for _, w in total], pa.binary()), "n": pa.array(list(total.values()), pa.int64())})


def _expect(model_of) -> object:
    """Expected counts (lang, piece, n) of pieces in batches of (lang, word, n), by the forward and backward sums."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = model_of()
        total = np.zeros((len(model.probs), len(model.langs)))
        for part in parts:
            column = part["lang"].map({x: k for k, x in enumerate(model.langs)}).to_numpy(np.int64)
            count, size = part["n"].to_numpy(float), part["word"].str.len().to_numpy()
            for n in np.unique(size):
                which = np.flatnonzero(size == n)
                for at_once in _parts(int(n), len(which)):
                    rows = which[at_once]
                    letters = np.empty((len(rows), n + 1), np.uint8)
                    letters[:, 0] = _MARK
                    letters[:, 1:] = np.frombuffer(b"".join(part["word"].iloc[rows]), np.uint8).reshape(len(rows), n)
                    stretches, col = _stretches(model.pieces, letters), column[rows]
                    alpha, beta = (f(stretches, int(n) + 1, model.pieces.longest, lambda piece, col=col: model.probs[piece, col]) for f in (forward, backward))
                    for i, j, piece in stretches:
                        hit = piece >= 0
                        x, y = piece[hit], col[hit]
                        np.add.at(total, (x, y), np.exp((alpha[i] + beta[j] - alpha[-1])[hit]) * model.probs[x, y] * count[rows][hit])
        at, col = np.nonzero(total[:-1])
        yield pd.DataFrame({"lang": np.array(model.langs, object)[col], "piece": at, "n": total[at, col]})

    return run


def _normal(counts: np.ndarray) -> np.ndarray:
    """Probabilities of counts by language, a little of each for what was not seen, and the row of zeros."""
    p = counts + 0.01
    return np.vstack([p / p.sum(axis=0), np.zeros((1, counts.shape[1]))])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str = VOCABULARY, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Learns from rows with a text and a language, of each language about ``sample`` rows, chosen by a hash of the id."""
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    langs, pieces = sorted(sizes), read_pieces(path)
    probs = _normal(np.ones((len(pieces.hashes), len(langs))))
    model = Model(langs, pieces, probs)
    if not langs:
        return model
    share = F.coalesce(*[F.when(F.col(lang) == x, F.lit(min(1.0, sample / n))) for x, n in sizes.items()])
    chosen = labelled.filter(draw(F.col(doc_id), "language") < share).select(text, lang)
    words = kept(chosen.mapInArrow(_sample_words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(model)
        counts = np.zeros((len(pieces.hashes), len(langs)))
        at = {x: k for k, x in enumerate(langs)}
        for r in words.mapInPandas(_expect(lambda sent=sent: sent.value), "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            counts[r["piece"], at[r["lang"]]] = r["n"]
        model = model._replace(probs=_normal(counts))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct (lang, score) for each row, and the column's name.

    lang is null where the text is null or has no letter; score is the posterior of lang under equal priors, 0 there. Whole
    texts are read; letters are A-Z, a-z and all characters beyond ASCII. Ties go to the first language by name.
    """
    name = fresh(docs.columns, "language")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    out = docs.mapInArrow(_score(docs.columns.index(text), lambda: sent.value, name), T.StructType([*docs.schema.fields, T.StructField(name, kind)]))
    return out, name
