"""Language identification with a linear-chain conditional random field over words.

A word's features are hashed affixes (1 to 3 bytes at either end), byte trigrams and
the word itself (lexicon); transition weights between the languages of neighbouring
words are learned with them. Forward-backward labels each word of code-switched text;
a document's language is the one with the largest sum of word posteriors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from seekspark.llm.common import CHUNK_BYTES, LETTER, Prefix, by_partition, chunks, expand, fresh_name, give_back, lowered, mix, utf8, word_spans, word_table

FEATURE_BITS = 18
#: The labelled texts that the model is fitted on: so many of each language at most, none longer than so many bytes.
SAMPLE_PER_LANG, SAMPLE_BYTES = 300, 20_000
#: Words of one piece of a chain: longer chains (a chain is a line) are worked on in pieces, whose ends exchange messages.
PIECE = 256
UNKNOWN = "und"
#: Documents whose words are less sure than this, on average, are in no learned language; so many sure words are added for short texts' benefit.
LEAST_SURE, DOUBT = 0.3, 2

_U = np.uint64
_ASCII_LETTER = word_table((0x41, 0x5A), (0x61, 0x7A))


class Words:
    """The words of a chunk of texts: spans, texts, chains, and features of the distinct ones."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        low = lowered(raw)
        self.start, self.end, self.doc = word_spans(low, off, LETTER)
        prefix = Prefix(low)
        h = prefix.of(self.start, self.end)
        keys, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        s, e = self.start[first], self.end[first]
        n = np.minimum(e - s, 3)
        parts, owners = [keys], [np.arange(len(keys))]
        for k in (1, 2, 3):
            has = np.flatnonzero(n >= k)
            parts += [mix(prefix.of(s[has], s[has] + k) + _U(k)), mix(prefix.of(e[has] - k, e[has]) + _U(8 + k))]
            owners += [has, has]
        at, owner = expand(s, np.maximum(0, e - s - 2))
        parts.append(mix(prefix.of(at, at + 3) + _U(16)))
        owners.append(owner)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.features = (np.concatenate(parts)[order] >> _U(64 - FEATURE_BITS)).astype(np.int64)
        self.begin = np.searchsorted(owner[order], np.arange(len(keys)))
        self.count = np.diff(np.r_[self.begin, len(self.features)])
        line = np.cumsum(raw == 10)[self.start] if len(raw) else np.zeros(0, np.int64)
        new = np.r_[True, (np.diff(self.doc) != 0) | (np.diff(line) != 0)] if len(self.doc) else np.zeros(0, bool)
        self.chain = np.flatnonzero(new)
        self.length = np.diff(np.r_[self.chain, len(new)])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Emission scores of each distinct word."""
        if not len(self.begin):
            return np.zeros((0, weights.shape[1]), np.float32)
        return np.add.reduceat(weights[self.features], self.begin, axis=0) / np.sqrt(self.count)[:, None].astype(np.float32)


def _steps(chain: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """For each place in a chain the words there, longest chains first."""
    order = np.argsort(-length, kind="stable")
    start, size = chain[order], length[order]
    alive = np.searchsorted(-size, -np.arange(size[0]) if len(size) else np.zeros(0), "left")
    return [start[:n] + t for t, n in enumerate(alive)]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def _passed_on(p: np.ndarray, move: np.ndarray, first: np.ndarray, chain: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of chains (start, length), forward messages at their first words and backward messages at their last.

    A piece maps the message that comes in to the one that goes out by one matrix, the
    product of its words'; so chains of any length take as many steps as they have pieces.
    """
    n = len(move)
    count = -(-length // PIECE)
    k, owner = expand(np.zeros(len(chain), np.int64), count)
    start = chain[owner] + k * PIECE
    size = np.minimum(PIECE, length[owner] - k * PIECE)
    into, out = first * p[start], np.ones((len(start), n), p.dtype)
    long = np.flatnonzero(count[owner] > 1)
    if len(long):
        through = np.empty((len(start), n, n), p.dtype)
        through[long] = np.eye(n, dtype=p.dtype)
        for t in range(1, PIECE):
            at = long[size[long] > t]
            through[at] = _scaled(through[at] @ move * p[start[at] + t][:, None, :])
        for i in range(1, int(count.max())):
            at = np.flatnonzero(k == i)
            into[at] = _scaled((into[at - 1][:, None, :] @ through[at - 1])[:, 0]) @ move * p[start[at]]
            into[at] = _scaled(into[at])
        for i in range(int(count.max()) - 1, 0, -1):
            at = np.flatnonzero(k == i)
            out[at - 1] = _scaled((p[start[at]] * (through[at] @ out[at][:, :, None])[:, :, 0]) @ move.T)
    return start, size, into, out


def forward_backward(e: np.ndarray, start: np.ndarray, trans: np.ndarray, chain: np.ndarray, length: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of each word's language, and the expected transitions if pairs."""
    p = np.exp(e - e.max(1, keepdims=True)) if len(e) else e
    a, b = np.empty_like(p), np.empty_like(p)
    move, first = np.exp(trans - trans.max()).astype(p.dtype), np.exp(start - start.max()).astype(p.dtype)
    begin, size, into, out = _passed_on(p, move, first, chain, length)
    steps = _steps(begin, size)
    a[begin], b[begin + size - 1] = _scaled(into), out
    for at in steps[1:]:
        a[at] = _scaled(p[at] * (a[at - 1] @ move))
    for at in steps[:0:-1]:
        b[at - 1] = _scaled((p[at] * b[at]) @ move.T)
    g = a * b
    g /= np.maximum(g.sum(1, keepdims=True), 1e-30)
    if not pairs:
        return g, None
    total = np.zeros_like(trans)
    inner = np.ones(len(p), bool)
    inner[chain] = False
    for at in np.array_split(np.flatnonzero(inner), len(p) // 65_536 + 1):
        total += _scaled(a[at - 1][:, :, None] * move * (p[at] * b[at])[:, None, :]).sum(0)
    return g, total


class Model:
    def __init__(self, langs: list[str]) -> None:
        n = len(langs)
        self.langs = langs
        self.weights = np.zeros((1 << FEATURE_BITS, n), np.float32)
        self.start, self.trans = np.zeros(n), np.zeros((n, n))
        self._seen = np.full_like(self.weights, 1e-3)

    def _learn(self, w: Words, grad: np.ndarray, rate: float) -> None:
        """AdaGrad on the emission weights; grad by distinct word."""
        rows = np.repeat(grad / np.sqrt(w.count)[:, None], w.count, axis=0)
        keys, at = np.unique(w.features, return_inverse=True)
        g = np.stack([np.bincount(at, rows[:, k], len(keys)) for k in range(grad.shape[1])], 1).astype(np.float32)
        self._seen[keys] += g * g
        self.weights[keys] += rate * g / np.sqrt(self._seen[keys])

    @staticmethod
    def _by_word(w: Words, per_place: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(w.of, per_place[:, k], len(w.begin)) for k in range(per_place.shape[1])], 1)

    def fit(self, texts: list[str], labels: list[int], rounds: int = 3) -> Model:
        n = len(self.langs)
        batches = []
        for a in range(0, len(texts), 100):
            raw, off = utf8(pa.array(texts[a : a + 100], pa.large_string()))
            w = Words(raw, off)
            if len(w.of):
                batches.append((w, np.array(labels[a : a + 100])[w.doc]))
        # First every word has its document's language.
        for _ in range(rounds):
            for w, y in batches:
                e = w.scores(self.weights)[w.of]
                p = np.exp(e - e.max(1, keepdims=True))
                self._learn(w, self._by_word(w, np.eye(n)[y] - p / p.sum(1, keepdims=True)), 0.1)
        # Then the field is fitted to words relabelled by their neighbourhood, where texts switch languages.
        own = np.log(0.5 / max(1, n - 1) + 0.5 * np.eye(n))
        for w, y in batches:
            e = w.scores(self.weights)[w.of].astype(np.float64)
            e -= np.log(np.exp(e - e.max(1, keepdims=True)).sum(1, keepdims=True)) + e.max(1, keepdims=True)
            total = np.r_[np.zeros((1, n)), np.cumsum(e + 0.5 * own[y], 0)]
            at, first, end = np.arange(len(e)), np.searchsorted(w.doc, w.doc, "left"), np.searchsorted(w.doc, w.doc, "right")
            y[:] = (total[np.minimum(at + 4, end)] - total[np.maximum(at - 3, first)]).argmax(1)  # no text learns from another's words
        for _ in range(rounds):
            for w, y in batches:
                g, pairs = forward_backward(w.scores(self.weights)[w.of].astype(np.float64), self.start, self.trans, w.chain, w.length, True)
                self._learn(w, self._by_word(w, np.eye(n)[y] - g), 0.05)
                inner = np.setdiff1d(np.arange(len(y)), w.chain)
                seen = np.bincount(y[inner - 1] * n + y[inner], minlength=n * n).reshape(n, n)
                self.trans += 2.0 * (seen - pairs) / max(1, len(inner))
                self.start += 2.0 * (np.bincount(y[w.chain], minlength=n) - g[w.chain].sum(0)) / max(1, len(w.chain))
        del self._seen
        return self

    def words(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of each word's language; and how sure the features of each distinct word are by themselves, from 0 to 1."""
        e = w.scores(self.weights)
        p = np.exp(e - e.max(1, keepdims=True))
        n = len(self.langs)
        sure = (n * p.max(1) / p.sum(1) - 1) / (n - 1) if n > 1 else np.ones(len(e))
        return forward_backward(e[w.of], self.start, self.trans, w.chain, w.length)[0], sure


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, per_lang: int = SAMPLE_PER_LANG, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on a bounded sample of the labelled rows: per_lang texts a language, by hash order."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.octet_length("text").between(1, max_bytes)).select("doc_id", "text", "lang")
    # Three times as many as needed are drawn by hash before any are sorted.
    h, share = F.xxhash64("doc_id"), F.lit(0)
    for r in rows.groupBy("lang").count().collect():  # the languages
        share = F.when(F.col("lang") == r.lang, min(1 << 30, (3 * per_lang << 30) // r["count"])).otherwise(share)
    order = W.Window.partitionBy("lang").orderBy(h, "doc_id", "text")
    ids = rows.where(F.pmod(h, F.lit(1 << 30)) < share).select("lang", "text", F.row_number().over(order).alias("k")).where(F.col("k") <= per_lang).orderBy(F.xxhash64("text"), "lang", "text").collect()
    langs = sorted({r.lang for r in ids})
    model = Model(langs).fit([r.text for r in ids], [langs.index(r.lang) for r in ids])
    del ids
    give_back()
    return model


def _labeller(shared, text_at: int):
    def make():
        model: Model = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text_at)
            raw, off = utf8(texts)
            n = len(off) - 1
            lang, score, sure, plain = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            for a, b in chunks(off, CHUNK_BYTES // 2) if model.langs else ():
                part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                letters = np.flatnonzero(_ASCII_LETTER[part])
                plain[a:b] = np.diff(np.searchsorted(letters, o)) > 0
                w = Words(part, o)
                g, of_words = model.words(w)
                mass = np.stack([np.bincount(w.doc, g[:, k], b - a) for k in range(len(model.langs))], 1)
                total = mass.sum(1)
                ok = total > 0
                lang[a:b] = np.where(ok, mass.argmax(1), -1)
                score[a:b][ok] = np.minimum(1, mass[ok].max(1) / total[ok])
                sure[a:b][ok] = ((np.bincount(w.doc, of_words[w.of], b - a) + DOUBT) / (np.bincount(w.doc, minlength=b - a) + DOUBT))[ok]
            for k in np.flatnonzero((lang >= 0) & ~plain):
                if not any(map(str.isalpha, texts[int(k)].as_py())):
                    lang[k], score[k], sure[k] = -1, 0, 0
            names = pa.array([*model.langs, UNKNOWN], pa.string())
            return [pa.StructArray.from_arrays([names.take(pa.array(lang % (len(model.langs) + 1))), pa.array(score), pa.array(sure)], ["lang", "score", "sure"])]

        return step

    return make


RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sure", T.DoubleType())])
WORD = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name is returned too): lang, score and sure.

    A null text, or one without a letter, is `und` with score 0; so is every text if the
    model was fitted on nothing. score is the language's share of all word posteriors, so
    a text that switches has a low one; sure is how sure the words are of any language.
    Whole texts are read; other columns pass through and rows that repeat are alike.
    """
    name = fresh_name(docs, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return by_partition(docs, _labeller(shared, docs.columns.index("text")), T.StructType([T.StructField(name, RESULT)])), name


def label_words(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """docs with an array column more (its name is returned too): start and end byte, lang and score of each word.

    Code-switched text has words of several languages. A text without words, a null one,
    and every text if the model was fitted on nothing, has none.
    """
    name = fresh_name(docs, "words")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def make():
        model: Model = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            raw, off = utf8(batch.column(text_at))
            n, parts = np.zeros(len(off) - 1, np.int64), []
            for a, b in chunks(off, CHUNK_BYTES // 2) if model.langs else ():
                w = Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                g, _ = model.words(w)
                at = off[a:b][w.doc] - off[a]
                n[a:b] = np.bincount(w.doc, minlength=b - a)
                parts.append((w.start - at, w.end - at, g.argmax(1) if len(g) else np.zeros(0, np.int64), g.max(1) if len(g) else np.zeros(0)))
            start, end, lang, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            words = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(model.langs, pa.string()).take(pa.array(lang)), pa.array(score.astype(np.float64))], ["start", "end", "lang", "score"])
            return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), words)]

        return step

    return by_partition(docs, make, T.StructType([T.StructField(name, T.ArrayType(WORD))])), name


def language_report(docs: DataFrame, **options) -> DataFrame:
    """Fits on the rows that aren't held out and labels all: doc_id, held_out, lang_pred, score."""
    out, name = identify(docs.select("doc_id", "text"), fit(docs, **options))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def keep_identified(docs: DataFrame, *, least_sure: float = LEAST_SURE, **options) -> DataFrame:
    """docs without those that have no language (`und`) or words of no learned language; columns as in docs.

    Texts that switch between learned languages stay. With nothing to learn from, all are `und` and go.
    """
    out, name = identify(docs, fit(docs, **options))
    return out.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["sure"] >= least_sure)).select(*docs.columns)
