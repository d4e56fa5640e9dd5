"""Subject areas of documents: sentences as weighted terms in a truncated singular value decomposition, compared by cosine
with one centroid a subject."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.hashing import uniform
from terrane.session import spread, staged

#: A word, a comma or the like, the end of a sentence or line, the end of a text.
_TOKEN = re.compile(r"[^\W\d_]+(?:['\-][^\W\d_]+)*|[,;:](?=\s)|[.!?…。](?=[\"»”)']*\s)|[\r\n\x85  ]|\x1e")
_UNSEEN = re.compile("[​﻿‌‍⁠­\x1e]")
_SENTENCE_END, _BREAK, _TEXT_END = -1, -2, -3
#: Words whose hash a worker remembers; characters of text and words that are worked on at a time.
REMEMBERED, CHARS, WORDS = 500_000, 4_000_000, 200_000
#: Numbers of terms' rows that are held at a time while they are summed.
CELLS = 2_000_000
#: Terms of a piece of the decomposition's sums, and how many tasks' pieces are added at a time.
PIECE, FAN_IN = 2048, 16


@dataclass(frozen=True)
class Settings:
    """max_labelled, max_words: labelled documents, and words in them, that centroids are fitted on at most (a sample by hash of the key beyond that).
    bits: terms are hashed to 2**bits numbers (15 at most). dims: of the embedding. passes: over all documents, for the
    decomposition. rounds, rate: of the centroids' refinement. sharp: how sharply a sentence's cosine over the threshold
    counts meanwhile."""

    max_labelled: int = 8000
    max_words: int = 4_000_000
    bits: int = 15
    dims: int = 96
    passes: int = 1
    rounds: int = 40
    rate: float = 0.02
    sharp: float = 100.0
    seed: int = 1


class _Words(dict):
    """The hash of each word, and the marks of what isn't one."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        if word == "\x1e":
            code = _TEXT_END
        elif word in ",;:":
            code = _BREAK
        elif word.isalpha() or len(word) > 1:
            code = zlib.crc32(word.encode())
        else:
            code = _SENTENCE_END
        self[word] = code
        return code


def _plain(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = _UNSEEN.sub("", text.replace("​", " ")).replace("’", "'")
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return text.replace("\x1e", " ").lower()


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)


def hashed(texts: list[str | None], bits: int, known: _Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, ends, word_ends, sentence_ends): for each word of the texts a 32-bit number holding the hashed word and the
    hashed pair with the word before it (or none, across a comma or a sentence's end); for each sentence where it ends,
    among its text's words; for each text where its words and its sentences end."""
    known = _Words() if known is None else known
    tokens = _TOKEN.findall("".join([f"{_plain(t)}\n\x1e" for t in texts]))
    codes = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    at = np.flatnonzero(codes >= 0)
    text = np.cumsum(codes == _TEXT_END)[at]
    sentence = np.cumsum((codes == _SENTENCE_END) | (codes == _TEXT_END))[at]
    word = codes[at].astype(np.uint64)
    none = np.uint64(1 << bits)
    pair = np.full(len(at), none)
    if len(at):
        then = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
        pair[then] = _mixed(word[then - 1] * np.uint64(0x9E3779B97F4A7C15) + word[then], bits)
    words = (_mixed(word + np.uint64(0x9E3779B9), bits) | (pair << np.uint64(16))).astype(np.uint32).view(np.int32)
    word_ends = np.searchsorted(text, np.arange(len(texts)), "right")
    last = np.flatnonzero(np.append(sentence[1:] != sentence[:-1], True)) if len(at) else np.zeros(0, np.int64)
    starts = np.append(0, word_ends)[text[last]]
    return words, (last + 1 - starts).astype(np.int32), word_ends, np.searchsorted(text[last], np.arange(len(texts)), "right")


def _terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words.view(np.uint32)
    return (w & np.uint32(0xFFFF)).astype(np.int64), (w >> np.uint32(16)).astype(np.int64)


def _summed(words: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of the table's rows of both terms of each word, for runs of words that begin at starts (none being empty)."""
    out = np.zeros((len(starts), *table.shape[1:]), table.dtype)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    step = max(1, CELLS // max(1, int(np.prod(table.shape[1:]))))  # words whose rows are held at a time
    for i in range(0, len(words), step):
        a, b = _terms(words[i : i + step])
        own = of[i : i + step]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first]] += np.add.reduceat(table[a] + table[b], first, axis=0)
    return out


def _padded(table: np.ndarray) -> np.ndarray:
    """With a row of zeros for no term."""
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])


@dataclass
class Model:
    """Unit centroids (dims x subjects) and the least cosine of each; weights of terms and the basis they are embedded by."""

    names: list[str]
    weights: np.ndarray
    basis: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    settings: Settings = field(default_factory=Settings)

    def embedded(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sentences as vectors: of unit length in all terms, then laid into the decomposition's dimensions."""
        size = _summed(words, starts, _padded(self.weights.astype(np.float64) ** 2))
        return (_summed(words, starts, _padded(self.basis * self.weights[:, None])) / np.sqrt(np.maximum(size, 1e-12))[:, None]).astype(np.float32)

    def scoring(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables (terms x subjects, terms) that give the cosine of a sentence with every centroid by two sums: the basis is
        orthonormal, so a unit centroid is as long among the terms as in it."""
        return _padded((self.basis * self.weights[:, None]) @ self.centroids).astype(np.float32), _padded(self.weights.astype(np.float32) ** 2)


def _normed(u: np.ndarray) -> np.ndarray:
    return u / np.maximum(np.linalg.norm(u, axis=0, keepdims=True), 1e-12)


def _best(cosines: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(cosines, docs, axis=0)


def thresholds(best: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """For each subject the cosine from which documents have it with the largest F1 (between two documents' cosines)."""
    out = np.full(truth.shape[1], 2.0)
    for k in range(truth.shape[1]):
        order = np.argsort(-best[:, k], kind="stable")
        c, hits = best[order, k], np.cumsum(truth[order, k])
        if hits[-1]:
            i = int((2 * hits / (np.arange(1, len(order) + 1) + hits[-1])).argmax())
            out[k] = (c[i] + c[min(i + 1, len(c) - 1)]) / 2
    return out


def refined(x: np.ndarray, docs: np.ndarray, truth: np.ndarray, seeds: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and least cosines after `rounds` rounds from the seeds.

    x: sentences, docs: the first sentence of each document. In each round every sentence is compared with every centroid;
    a centroid moves towards the sentences nearest to it in documents that are labelled with its subject, and away from
    those that pass its threshold in documents that aren't, and is made unit length again. A sentence counts the more, the
    further its cosine is over the threshold, and less if its document is told by another sentence already. Thresholds rise
    where too many pass and fall where too few do; the last ones are those of `thresholds`.
    """
    u = _normed(seeds).astype(np.float32)
    least = thresholds(_best(x @ u, docs), truth).astype(np.float32)
    of = np.repeat(np.arange(len(docs)), np.diff(np.append(docs, len(x))))
    pace = [[np.zeros_like(u), np.zeros_like(u)], [np.zeros_like(least), np.zeros_like(least)]]

    def step(move: np.ndarray, at: int, turn: int) -> np.ndarray:
        """A step of like size in all dimensions, whatever the number of documents, that keeps some of the last ones' way."""
        way, size = pace[at]
        way += 0.1 * (move - way)
        size += 0.001 * (move * move - size)
        return s.rate * (way / (1 - 0.9**turn)) / (np.sqrt(size / (1 - 0.999**turn)) + 1e-9)

    for turn in range(1, s.rounds + 1):
        z = np.clip(np.float32(s.sharp) * (x @ u - least), -30, 30)
        near = 1 / (1 + np.exp(-z))
        told = np.clip(1 - np.exp(np.add.reduceat(-np.logaddexp(np.float32(0), z), docs, axis=0)), 1e-6, 1)
        away = np.where(truth > 0, (told - 1) / told, 1.0).astype(np.float32)[of] * near / np.float32(len(docs))
        u = _normed(u - step(np.float32(s.sharp) * (x.T @ away), 0, turn)).astype(np.float32)
        least = least + step(np.float32(s.sharp) * away.sum(0), 1, turn).astype(np.float32)
    return u, thresholds(_best(x @ u, docs), truth)


def relevance(words: np.ndarray, of: np.ndarray, truth: np.ndarray, size: int) -> np.ndarray:
    """How much each term tells of a subject: the divergence of a subject's share among the documents with the term from
    its share among all (smoothed), of the subject for which it is largest. of: the document of each word."""
    a, b = _terms(words)
    seen = np.unique(np.concatenate([of * (size + 1) + a, of * (size + 1) + b]))
    doc, term = seen // (size + 1), seen % (size + 1)
    doc, term = doc[term < size], term[term < size]
    n = np.bincount(term, minlength=size).astype(float)
    base = np.clip(truth.mean(0), 1e-4, 1 - 1e-4)
    most = np.zeros(size)
    for k in range(truth.shape[1]):
        share = np.clip((np.bincount(term, truth[doc, k], size) + 2 * base[k]) / (n + 2), 1e-6, 1 - 1e-6)
        most = np.maximum(most, share * np.log(share / base[k]) + (1 - share) * np.log((1 - share) / (1 - base[k])))
    return most


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def features(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """(key, words, ends) of each document of known key, as `hashed` gives them, the texts being read whole."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in it:
            texts = batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and (z == a or size + len(texts[z] or "") <= CHARS):
                    size += len(texts[z] or "")
                    z += 1
                words, ends, word_ends, sentence_ends = hashed(texts[a:z], bits, known)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, e).astype(np.int32)), pa.array(v)) for v, e in ((words, word_ends), (ends, sentence_ends))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *lists], names=[key, "words", "ends"])
                a = z

    chosen = spread(docs.filter(F.col(key).isNotNull()).select(key, text), key, text)
    kinds = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("words", "ends")]
    return chosen.mapInArrow(run, T.StructType([chosen.schema[key], *kinds]))


def occurrences(told: DataFrame, size: int) -> np.ndarray:
    """How often each term occurs in all documents: a task gives one number for each term it has met."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in it:
            for t in _terms(_lists(batch.column(0))[0]):
                total += np.bincount(t, minlength=size + 1)
        met = np.flatnonzero(total[:size])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["i", "n"])

    out = np.zeros(size)
    for r in told.select("words").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a term
        out[r.i] = r.n
    return out


def decomposed(told: DataFrame, weights: np.ndarray, s: Settings) -> np.ndarray:
    """The leading right singular vectors of the matrix of all documents by weighted terms, by subspace iteration.

    Each pass multiplies by the matrix and its transpose in one go. A task gives one sum (terms x dims, 8 MB by default) in pieces
    of PIECE terms; pieces are added FAN_IN at a time, in as many steps as the number of tasks takes, so that no task and
    not the driver holds more than FAN_IN of them.
    """
    spark = told.sparkSession
    size = len(weights)
    basis = np.linalg.qr(np.random.default_rng(s.seed).standard_normal((size, min(s.dims, size))))[0].astype(np.float32)
    dims = basis.shape[1]

    def turned(sent):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, v = sent.value
            total = np.zeros((size, dims), np.float32)
            for batch in it:
                words, ends = _lists(batch.column(0))
                a = 0
                while a < len(ends) - 1:
                    # as many documents as have few words together, one longer document being a run of its own
                    z = max(a + 1, min(a + 64, int(np.searchsorted(ends, ends[a] + WORDS, "right")) - 1))
                    n = np.diff(ends[a : z + 1])
                    one, two = _terms(words[ends[a] : ends[z]])
                    doc = np.tile(np.repeat(np.arange(z - a), n), 2)
                    term = np.concatenate([one, two])
                    doc, term = doc[term < size], term[term < size]
                    if len(term):
                        used, at = np.unique(term, return_inverse=True)
                        m = np.bincount(doc * len(used) + at, w[term], (z - a) * len(used)).reshape(z - a, -1).astype(np.float32)
                        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
                        total[used] += m.T @ (m @ v[used])
                    a = z
            pieces = [total[i : i + PIECE] for i in range(0, size, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "sum"])

        return run

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["sum"])
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "task": [pdf["task"].iloc[0] // FAN_IN], "sum": [total.astype(np.float32).tobytes()]}).astype({"piece": "int32", "task": "int32"})

    rows = told.select("words")
    tasks = rows.rdd.getNumPartitions()
    for _ in range(s.passes):
        sent = spark.sparkContext.broadcast((weights.astype(np.float64), basis))
        sums = rows.mapInArrow(turned(sent), "piece int, sum binary").withColumn("task", F.spark_partition_id())
        left = tasks
        while left > 1:
            sums = sums.groupBy("piece", F.floor(F.col("task") / FAN_IN).alias("__g")).applyInPandas(added, "piece int, task int, sum binary")
            left = -(-left // FAN_IN)
        found = {r.piece: np.frombuffer(r.sum, np.float32).reshape(-1, dims) for r in sums.collect()}
        if not found:
            return basis
        basis = np.linalg.qr(np.concatenate([found[i] for i in sorted(found)]).astype(np.float64))[0].astype(np.float32)
    return basis


def fit(told: DataFrame, subjects: DataFrame, labels: DataFrame, key: str, s: Settings) -> Model:
    """The model of (key, words, ends) of all documents. Of labelled documents only hashed words reach the driver, at most
    max_words of them together."""
    size = 1 << s.bits
    described = sorted({(r.subject, r.description or "") for r in subjects.select("subject", "description").dropna(subset=["subject"]).collect()})
    names = sorted({n for n, _ in described})
    place = {n: i for i, n in enumerate(names)}
    chosen = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("subject").alias("__own"), F.max(uniform(key, seed=s.seed)).alias("__u"))
    known = told.join(chosen, key).withColumn("__n", F.size("words"))
    sizes = known.select("__u", "__n").orderBy("__u").limit(s.max_labelled).collect()
    upto = np.cumsum([r[1] for r in sizes])
    few = [r[0] for r, n in zip(sizes, upto) if n <= s.max_words]
    texts: list[tuple[np.ndarray, np.ndarray]] = []
    truth: list[np.ndarray] = []

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols = []
            for c in (batch.column(0), batch.column(1)):
                flat, ends = _lists(c)
                cols.append(pa.array([flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays([*cols, batch.column(2), batch.column(3)], names=["words", "ends", "own", "u"])

    if few:
        rows = known.filter(F.col("__u") <= few[-1]).select("words", "ends", "__own", "__u").mapInArrow(packed, "words binary, ends binary, own array<string>, u double").collect()
        for r in sorted(rows, key=lambda r: (r.u, r.words)):
            texts.append((np.frombuffer(r.words, np.int32), np.frombuffer(r.ends, np.int32)))
            truth.append(np.array([float(n in r.own) for n in names], np.float32))
    for n, description in described:
        for t in (description, f"{n}. {description}"):
            words, ends, _, _ = hashed([t], s.bits)
            texts.append((words, ends))
            truth.append(np.eye(len(names), dtype=np.float32)[place[n]])
    kept = [i for i, (words, _) in enumerate(texts) if len(words)]
    if not names or not kept:
        return Model(names, np.ones(size, np.float32), np.zeros((size, 1), np.float32), np.zeros((1, len(names)), np.float32), np.full(len(names), 2.0), s)
    words = np.concatenate([texts[i][0] for i in kept])
    y = np.stack([truth[i] for i in kept])
    lengths = [len(texts[i][0]) for i in kept]
    before = np.append(0, np.cumsum(lengths))[:-1]
    starts = np.concatenate([b + np.append(0, texts[i][1][:-1]) for i, b in zip(kept, before)]).astype(np.int64)
    docs = np.append(0, np.cumsum([len(texts[i][1]) for i in kept]))[:-1]

    seen = occurrences(told, size)
    # the rarer a term and the more it tells of a subject, the more it weighs; one that labelled documents lack weighs little, not nothing
    rare = np.maximum(np.log((seen.sum() + 1) / (seen + 1)) - 3, 0.1)
    weights = (rare * np.sqrt(relevance(words, np.repeat(np.arange(len(kept)), lengths), y, size) + 0.01)).astype(np.float32)
    model = Model(names, weights, decomposed(told, weights, s), np.zeros((1, len(names)), np.float32), np.zeros(len(names)), s)
    x = model.embedded(words, starts)
    # seeds: a subject's description and the documents of that subject alone, against the mean of all
    alone = (y / np.maximum(y.sum(1, keepdims=True), 1)) ** 2
    of = np.repeat(np.arange(len(docs)), np.diff(np.append(docs, len(x))))
    seeds = (x.T @ alone[of]) / np.maximum(alone[of].sum(0), 1e-9) - x.mean(0)[:, None]
    model.centroids, model.least = refined(x, docs, y, seeds, s)
    return model


def assigned(docs: DataFrame, subjects: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(key, subject) for each subject of `subjects` that a document treats in sentences of its own, each pair once.

    labels: (key, subject) for all subjects of some documents, a null subject for a document without any. A document's
    sections are its sentences, embedded by weighted terms (words and pairs of neighbours, all of them, by hash) and the
    truncated singular value decomposition of all documents, and compared by cosine with one unit centroid a subject; a
    document has a subject if one of its sentences reaches the subject's least cosine. Centroids begin as the subjects'
    descriptions and the documents labelled with one subject, and are refined round by round (`refined`), on a bounded
    sample of labelled documents; terms' counts and the decomposition are those of all documents. Null, empty and blank
    texts, and null keys, have no subject. Texts are read whole. Without labels the descriptions
    alone are the examples. Without documents or subjects there are no rows.
    """
    s = settings or Settings()
    told = staged(features(docs, key, text, s.bits))
    model = fit(told, subjects, labels, key, s)
    sent = docs.sparkSession.sparkContext.broadcast((model.names, *model.scoring(), model.least.astype(np.float32)))

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, squares, least = sent.value
        for batch in it:
            if not names:
                continue
            (words, word_ends), (ends, sentence_ends) = _lists(batch.column(1)), _lists(batch.column(2))
            a = 0
            while a < len(batch):
                z = max(a + 1, int(np.searchsorted(word_ends, word_ends[a] + WORDS, "right")) - 1)
                counts = np.diff(sentence_ends[a : z + 1])
                rows = np.flatnonzero(counts)
                if len(rows):
                    # where each sentence ends, and so where the next begins, among the words of these rows
                    stops = ends[sentence_ends[a] : sentence_ends[z]] + np.repeat(word_ends[a:z] - word_ends[a], counts)
                    starts = np.append(0, stops[:-1]).astype(np.int64)
                    own = words[word_ends[a] : word_ends[z]]
                    cosines = _summed(own, starts, table) / np.sqrt(np.maximum(_summed(own, starts, squares), 1e-12))[:, None]
                    at, which = np.nonzero(_best(cosines, np.cumsum(counts[rows]) - counts[rows]) >= least)
                    keys = batch.column(0).take(pa.array(a + rows[at], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([names[c] for c in which], pa.string())], names=[key, "subject"])
                a = z

    return told.mapInArrow(score, T.StructType([told.schema[key], T.StructField("subject", T.StringType())])).distinct()
