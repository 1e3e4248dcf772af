"""Toxicity scores from a lexicon of terms, their misspellings, and where they stand.

The lexicon is a trie. A Levenshtein automaton intersected with it becomes one
deterministic automaton over bytes: its states are the sets of (trie node, edits) that
a prefix can reach, so that one step for each byte of a word finds the term that the
word is, or is one edit away from. The words around a hit decide whether it is quoted
(inside quotation marks, or after a word of saying) or meant; both counts go into a
logistic model that is fitted on labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import Prefix, by_partition, chunks, discard, fresh_name, lookup, lowered, small_side, stored, utf8, word_spans, word_table

# General insults that any lexicon here starts with, words of saying, and quotation marks.
SEED_TERMS = ("clown", "disgusting", "dumb", "filth", "idiot", "jerk", "liar", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
SAYING = ("said", "says", "called", "calls", "quote", "quoted", "word", "term", "dit", "sagte", "dijo")
QUOTES = ('"', "“", "”", "„", "«", "»")

#: The labelled rows that the model is fitted on: so many of each label at most, none longer than so many bytes.
SAMPLE_PER_LABEL, SAMPLE_BYTES = 3000, 20_000
#: The evidence that a learned term needs (log-likelihood ratio), and the words at either side that count as context.
EVIDENCE, CONTEXT = 20.0, 6
#: Shorter terms have to be spelled exactly.
FUZZY_LENGTH = 5
#: Bytes of learned stems.
STEMS = range(5, 13)
#: Bytes of the sample's texts of one label, together, at most.
FIT_BYTES = 16 << 20

#: Letters, digits and all bytes beyond ASCII, after lower-casing.
_WORD = word_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
FEATURES = ("meant", "quoted", "misspelled", "evidence", "density")


def _plain(raw: np.ndarray) -> np.ndarray:
    """The bytes lower-cased, and spaces for punctuation beyond ASCII, which ends words too.

    That is U+00A0 to U+00BF but for ª, µ and º, U+2000 to U+206F but for the joiners, and U+3000 to U+303F.
    """
    low = lowered(raw)
    if len(raw) < 2:
        return low
    a, b = raw[:-1], raw[1:]
    two = np.flatnonzero((a == 0xC2) & (b >= 0xA0) & ~np.isin(b, (0xAA, 0xB5, 0xBA)))
    low[two] = low[two + 1] = 0x20
    if len(raw) > 2:
        c = raw[2:]
        a, b = a[:-1], b[:-1]
        at = np.flatnonzero(((a == 0xE2) & ((b == 0x80) & (c != 0x8C) & (c != 0x8D) | (b == 0x81) & (c < 0xB0))) | (a == 0xE3) & (b == 0x80))
        low[at] = low[at + 1] = low[at + 2] = 0x20
    return low


class Automaton:
    """The product of the lexicon's trie and the Levenshtein automaton of up to `edits` edits.

    A term that ends in * is a stem: any word that begins with it, spelled exactly, fits.
    A term spelled exactly goes before the stems it begins with, and a longer stem before a
    shorter one; a misspelled term counts where no stem fits.
    """

    def __init__(self, terms: list[bytes], edits: int = 1) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        strict: set[int] = set()
        stems: dict[int, int] = {}
        for k, term in enumerate(terms):
            node, stem = 0, term.endswith(b"*")
            term = term.removesuffix(b"*")
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            (stems if stem else ends)[node] = k
            if len(term) < FUZZY_LENGTH:
                strict.add(node)

        def closed(states: dict[int, int]) -> tuple[tuple[int, int], ...]:
            todo = [*states.items()]
            while todo:  # a letter of the term is left out
                node, e = todo.pop()
                if e < edits and states[node] == e:
                    for child in children[node].values():
                        if states.get(child, edits + 1) > e + 1:
                            states[child] = e + 1
                            todo.append((child, e + 1))
            return tuple(sorted(states.items()))

        def within(stem: int, node: int | None) -> tuple[tuple[int, int], ...]:
            """The longest stem so far (its number below 0), and the exact node beside it while the trie has one."""
            if node is None:
                return ((stem, 0),)
            stem = -1 - stems[node] if node in stems else stem
            return ((stem, 0), (node, 0)) if children[node] or node in ends else ((stem, 0),)

        def stepped(state: tuple[tuple[int, int], ...], c: int) -> tuple[tuple[int, int], ...]:
            if state[0][0] < 0:  # within a stem's word: only exact terms and longer stems matter
                node = children[state[1][0]].get(c) if len(state) > 1 else None
                return within(state[0][0], node)
            out: dict[int, int] = {}
            put = lambda node, e: out.__setitem__(node, min(e, out.get(node, edits + 1)))
            for node, e in state:
                if c in children[node]:
                    if e == 0 and children[node][c] in stems:
                        return within(0, children[node][c])
                    put(children[node][c], e)
                if e < edits:
                    put(node, e + 1)
                    for child in children[node].values():
                        put(child, e + 1)
            return closed(out)

        letters = sorted({c for t in terms for c in t})
        start = closed({0: 0})
        number, queue, table = {(): 0, start: 1}, [start], [[0] * (len(letters) + 1)]
        accept = [(-1, 0)]
        for state in queue:
            known = {c for node, _ in state if node >= 0 for c in children[node]}
            step = {}
            for c in [-1, *sorted(known)]:  # all other letters lead where an unknown one does
                to = stepped(state, c)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                step[c] = number[to]
            table.append([step.get(c, step[-1]) for c in letters] + [step[-1]])
            found = min(((e, ends[node]) for node, e in state if node in ends and (e == 0 or node not in strict)), default=None)
            if state[0][0] < 0 and (found is None or found[0] > 0):
                found = (0, -1 - state[0][0])
            accept.append((found[1], found[0]) if found else (-1, 0))
        self.step = np.array(table, np.int32)
        self.column = np.full(256, len(letters), np.int64)
        self.column[letters] = np.arange(len(letters))
        self.term, self.edits = np.array([a[0] for a in accept]), np.array([a[1] for a in accept])
        self.least = min((len(t.removesuffix(b"*")) for t in terms), default=1) - edits
        self.most = max(map(len, terms), default=0) + edits
        #: States that no letter leaves: within a stem's word, beyond all terms.
        self.final = (self.step == np.arange(len(table))[:, None]).all(1)

    def match(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are terms, which term each is, and at how many edits. Words of any length are looked at."""
        size = end - start
        live = np.flatnonzero(size >= self.least)
        state, done = np.ones(len(live), np.int32), []
        for t in range(self.most + 2):
            over = (size[live] == t) | self.final[state]
            done.append((live[over], state[over]))
            live, state = live[~over], state[~over]
            state = self.step[state, self.column[raw[start[live] + t]]]
            live, state = live[state > 0], state[state > 0]
        words, states = (np.concatenate(x) for x in zip(*done, strict=True))
        hit = self.term[states] >= 0
        return words[hit], self.term[states[hit]], self.edits[states[hit]]


class Scorer:
    """Lexicon, automaton and the fitted logistic model."""

    def __init__(self, terms: dict[str, float], clean: set[str]) -> None:
        self.terms = sorted(terms)
        self.weight = np.array([terms[t] for t in self.terms])
        self.automaton = Automaton([t.encode() for t in self.terms])
        keys = lambda words: np.unique(_hashes(sorted(words)))
        #: Ordinary words that happen to be one edit from a term aren't misspellings.
        self.clean, self.saying = keys(clean), keys(SAYING)
        self.coef = np.array([-2.0, 3.0, 0.0, 1.0, 0.0, 0.0])

    def features(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row for each text: the FEATURES."""
        low = _plain(raw)
        start, end, doc = word_spans(low, off, _WORD)
        out = np.zeros((len(off) - 1, len(FEATURES)))
        word, term, edits = self.automaton.match(low, start, end)
        if not len(word):
            return out
        order = np.argsort(word, kind="stable")
        word, term, edits = word[order], term[order], edits[order]
        h = Prefix(low)
        own = h.of(start[word], end[word])
        fuzzy = np.flatnonzero(edits > 0)
        ordinary, _ = lookup(self.clean, own[fuzzy])
        keep = np.ones(len(word), bool)
        keep[fuzzy[ordinary]] = False
        word, term, edits = word[keep], term[keep], edits[keep]
        quoted = self._quoted(raw, off, h, start, end, doc, word)
        d = doc[word]
        for k, flag in enumerate((~quoted & (edits == 0), quoted, ~quoted & (edits > 0))):
            out[:, k] = np.bincount(d, flag, len(out))
        np.maximum.at(out[:, 3], d, np.where(quoted, 0, self.weight[term] / (1 + edits)))
        words = np.bincount(doc, minlength=len(out))
        out[:, 4] = np.log1p(100 * (out[:, 0] + out[:, 2]) / np.maximum(1, words))
        out[:, :3] = np.log1p(out[:, :3])
        return out

    def _quoted(self, raw: np.ndarray, off: np.ndarray, h: Prefix, start: np.ndarray, end: np.ndarray, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Hits between quotation marks, or after a word of saying, within CONTEXT words at either side (in the same text)."""
        d = doc[word]
        first = np.searchsorted(doc, d, "left")
        last = np.searchsorted(doc, d, "right") - 1
        a, b = np.maximum(word - CONTEXT, first), np.minimum(word + CONTEXT, last)
        lo = np.where(a > first, end[np.maximum(a - 1, 0)], off[d])
        hi = np.where(b < last, start[np.minimum(b + 1, len(start) - 1)], off[d + 1])
        marks = _marks(raw)
        some = lambda where, x, y: np.searchsorted(where, y) > np.searchsorted(where, x)
        said = lookup(self.saying, h.of(start, end))[0]
        return some(marks, lo, start[word]) & some(marks, end[word], hi) | some(said, a, word)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Scorer:
        """Weighted ridge-regularised logistic regression by Newton steps."""
        if len({*y.tolist()}) < 2:
            return self
        x = np.c_[np.ones(len(x)), x]
        c = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            g = x.T @ (weight * (y - p)) - 0.1 * c
            c = np.clip(c + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(c)), g), -30, 30)
        self.coef = c
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ self.coef, -30, 30)))


def _marks(raw: np.ndarray) -> np.ndarray:
    """Where quotation marks begin."""
    at = []
    for q in (q.encode() for q in QUOTES):
        hit = np.flatnonzero(raw == q[0])
        for k, c in enumerate(q[1:], 1):
            hit = hit[hit + k < len(raw)]
            hit = hit[raw[hit + k] == c]
        at.append(hit)
    return np.sort(np.concatenate(at))


def _hashes(words: list[str]) -> np.ndarray:
    raw, off = utf8(pa.array(words, pa.large_string()))
    return Prefix(raw).of(off[:-1], off[1:])


def _words_of(texts: list[str]) -> Iterator[set[str]]:
    for t in texts:
        raw, off = utf8(pa.array([t], pa.large_string()))
        low = _plain(raw)
        start, end, _ = word_spans(low, off, _WORD)
        whole = low.tobytes()
        yield {whole[a:b].decode("utf-8", "ignore") for a, b in zip(start.tolist(), end.tolist(), strict=True)}


def _evidence(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of a word in a of n1 toxic and b of n0 other texts."""
    p = (a + b) / (n1 + n0)
    part = lambda k, n, q: (k * np.log(k / (n * q)) if k else 0) + ((n - k) * np.log((n - k) / (n * (1 - q))) if n > k else 0)
    return 2 * (part(a, n1, p) + part(b, n0, p)) if 0 < p < 1 else 0.0


def _stem(word: str, size: int) -> str | None:
    """The beginning of word that has size bytes, if that is whole characters."""
    if word.isascii():
        return word[:size] + "*" if len(word) >= size else None
    return next((word[:k] + "*" for k in range(1, min(len(word), size) + 1) if len(word[:k].encode()) == size), None)


def _stems_of(word: str) -> set[str]:
    return {x for size in STEMS if (x := _stem(word, size))}


def _learned(words: Iterator[set[str]], y: np.ndarray, n1: float, n0: float) -> tuple[dict[str, float], list[Counter]]:
    """All terms and stems with enough evidence, each with its weight, and how many texts of each label have a word.

    A stem is kept if it is in more toxic texts than any one word that begins with it, and as
    clean as each such word and longer stem (those that fewer than three toxic texts have don't
    count). Stems that a kept one covers add nothing and are left out; words stay, as only
    they are found misspelled.
    """
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(x, len(number)) for x in w], np.int32) for w in words]
    text, word = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate([*ids, np.zeros(0, np.int32)])
    counts, stems = [Counter(), Counter()], [Counter(), Counter()]
    for label in (0, 1):
        n = np.bincount(word[y[text] == label], minlength=len(number)).tolist()
        counts[label].update({w: k for w, k in zip(number, n, strict=True) if k})
    # Stems of one length at a time, of words whose shorter stems are in three toxic texts.
    alive = np.ones(len(number), bool)
    for size in STEMS:
        stem, of = np.full(len(number), -1), {}
        for k, w in enumerate(number):
            if alive[k] and (x := _stem(w, size)):
                stem[k] = of.setdefault(x, len(of))
        at = stem[word] >= 0
        pair = np.unique(text[at] * max(1, len(of)) + stem[word[at]])  # each text counts once
        t, k = np.divmod(pair, max(1, len(of)))
        n = [np.bincount(k[y[t] == label], minlength=len(of)) for label in (0, 1)]
        for x, i in of.items():
            if n[1][i] >= 3:
                stems[0][x], stems[1][x] = int(n[0][i]), int(n[1][i])
        alive[stem >= 0] = n[1][stem[stem >= 0]] >= 3
    usable = lambda w, at: at[1][w] >= 3 and len(w.encode()) >= 4 and at[1][w] / n1 > 4 * at[0][w] / n0
    gain = lambda w, at: 1.0 + np.log1p(g / EVIDENCE) if (g := _evidence(at[1][w], at[0][w], n1, n0)) >= EVIDENCE else 0.0
    out = {w: gain(w, counts) for w in counts[1] if usable(w, counts)}
    good = [x for x in stems[1] if usable(x, stems)]
    most, purest = Counter(), {}
    for inner, at in ((out, counts), (good, stems)):
        for w in inner:
            pure = at[1][w] / (at[0][w] + 1)
            for x in _stems_of(w.removesuffix("*")) - {w}:
                most[x] = max(most[x], at[1][w] if at is counts else 0)
                purest[x] = max(purest.get(x, 0.0), pure)
    kept: set[str] = set()
    for x in sorted(good, key=lambda x: (len(x), x)):
        if stems[1][x] > most[x] and stems[1][x] / (stems[0][x] + 1) >= purest.get(x, 0.0) and not _stems_of(x[:-1]) & kept and gain(x, stems):
            kept.add(x)
    return {w: v for w, v in out.items() if v} | {x: gain(x, stems) for x in kept}, counts


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = SAMPLE_PER_LABEL, max_bytes: int = SAMPLE_BYTES, fit_bytes: int = FIT_BYTES) -> Scorer:
    """Learns terms, context weights and calibration from a bounded sample of the labelled rows that aren't held out.

    Of each label per_label documents by hash order and fit_bytes of text together, at most, come to the driver; of
    rows that repeat a doc_id the least text counts, once.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Twice as many ids as needed are drawn by hash, as some have no text, or too long a one.
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_label)
        drawn = part if drawn is None else drawn.union(part)
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, max_bytes)).join(small_side(drawn, 4 * per_label), "doc_id")
    texts = stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    rows, size, chosen = Counter(), Counter(), []
    for r in texts.select("doc_id", "toxic", F.octet_length("text").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # 4 * per_label numbers at most
        rows[r.toxic] += 1
        size[r.toxic] += r.bytes
        if rows[r.toxic] <= per_label and size[r.toxic] <= fit_bytes:
            chosen.append((r.doc_id,))
    ids = docs.sparkSession.createDataFrame(chosen, texts.select("doc_id").schema)
    sample = texts.join(small_side(ids, len(chosen)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    discard(texts)
    texts, y = [r.text for r in sample], np.array([r.toxic for r in sample], np.float64)
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    learned, counts = _learned(_words_of(texts), y, n1, n0)
    terms = {w: 1.0 for w in SEED_TERMS if 4 * counts[0][w] / n0 <= max(counts[1][w] / n1, 4 / n0)} | learned
    scorer = Scorer(terms, {w for w in counts[0] if w not in terms})
    x = np.zeros((len(texts), len(FEATURES)))
    for a in range(0, len(texts), 500):
        raw, off = utf8(pa.array(texts[a : a + 500], pa.large_string()))
        x[a : a + 500] = scorer.features(raw, off)
    share = {0: total.get(0, 0) / n0, 1: total.get(1, 0) / n1}
    weight = np.array([share[int(v)] for v in y])
    return scorer.fit(x, y, weight / weight.mean() if len(weight) else weight)


def _scored(shared, text_at: int):
    def make():
        scorer: Scorer = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            raw, off = utf8(batch.column(text_at))
            out = np.zeros((len(off) - 1, len(FEATURES)))
            for a, b in chunks(off):
                out[a:b] = scorer.features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            meant, quoted = (np.rint(np.expm1(out[:, k])).astype(np.int64) for k in (0, 1))
            fuzzy = np.rint(np.expm1(out[:, 2])).astype(np.int64)
            return [pa.StructArray.from_arrays([pa.array(scorer.score(out)), pa.array(meant), pa.array(quoted), pa.array(fuzzy)], ["score", "meant", "quoted", "misspelled"])]

        return step

    return make


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("meant", T.LongType()), T.StructField("quoted", T.LongType()), T.StructField("misspelled", T.LongType())])


def score_toxicity(docs: DataFrame, scorer: Scorer) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name is returned too): score, and how many hits are meant, quoted and misspelled.

    Null and empty texts have no hit and the score of a text without any. Whole texts are
    read; other columns pass through and rows that repeat are alike. Without labels of
    both kinds the seed terms alone count, with fixed weights.
    """
    name = fresh_name(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return by_partition(docs, _scored(shared, docs.columns.index("text")), T.StructType([T.StructField(name, RESULT)])), name


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on the labelled rows that aren't held out and scores all: doc_id, held_out, score, predicted."""
    out, name = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels, **options))
    score = F.col(name)["score"]
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
