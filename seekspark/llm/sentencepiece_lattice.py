"""SentencePiece encoding and decoding over a relational lattice.

Words (a run of word marks with what follows, or a line break: no piece crosses their
ends) are exploded to all substrings up to the longest piece's length and equi-joined
to the piece table; the matching edges are grouped by word, and a higher-order
aggregate folds Viterbi over them: the segmentation with the largest sum of piece
scores. Characters without a piece are edges of their UTF-8 byte pieces. The lattice is
built for the vocabulary, the words that batches of the corpus repeat, up to a bound on
its size; the executors spell documents with it, and fold the same lattice in place for
each word beyond it. Decoding is a lookup of each id in the piece table.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import by_partition, fresh_name, give_back, stored

MARK = "▁"
#: Words in the vocabulary at most, and the longest (in bytes).
VOCABULARY, LONGEST = 300_000, 64
#: What a character without a piece scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words whose edges one task groups, about.
LATTICE_WORDS = 10_000
#: Words that a task remembers besides the vocabulary.
REMEMBERED = 50_000

_MARK = MARK.encode()
#: Words in UTF-8, with a space for each word mark.
_WORDS = re.compile(rb" +[^ \n]*|\n|[^ \n]+")


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: text, id and score of its ordinary pieces, and the id of each byte's piece."""

    text: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    decoded: tuple[bytes, ...]
    unknown: int

    @property
    def longest(self) -> int:
        return max(map(len, self.text), default=1)

    @property
    def fallback(self) -> float:
        return min(self.scores, default=0.0) - UNKNOWN_PENALTY

    def spelled(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown,)


def load_pieces(path: str) -> Pieces:
    """Reads the piece table; the model's file is needed on the driver only.

    Words are encoded one by one, so a model with a piece that goes over a word's end is refused.
    """
    import os

    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no SentencePiece model at {path}")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    if over := [m.id_to_piece(i) for i in plain if len(_words(m.id_to_piece(i).encode())) != 1]:
        raise ValueError(f"pieces go over the ends of words: {over[:5]}")
    byte_ids = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
    decoded = [b""] * n
    for i in plain:
        decoded[i] = m.id_to_piece(i).replace(MARK, " ").encode()
    for b, i in byte_ids.items():
        decoded[i] = bytes([b])
    return Pieces(tuple(m.id_to_piece(i) for i in plain), tuple(plain), tuple(float(m.get_score(i)) for i in plain), tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (), tuple(decoded), m.unk_id())


def _words(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.replace(_MARK, b" "))


def _words_of(texts: pa.Array) -> Iterator[list[bytes] | None]:
    """The words of each text, before which a word mark is put; of an empty one none, of a null None."""
    for t in texts.cast(pa.binary()).to_pylist():
        yield _words(b" " + t) if t else t if t is None else []


def _vocabulary(docs: DataFrame, size: int) -> DataFrame:
    """The words that batches repeat, most frequent first, no more than size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for words in _words_of(batch.column(0)):
                seen.update(words or ())
            often = [(w, n) for w, n in seen.items() if n > 1 and len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["word", "n"])
            del seen, often
        give_back()

    counts = stored(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # The least count at which the words still fit, from a histogram of counts above 10,000 in powers of two.
    step = F.when(F.col("n") <= 10_000, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    least, total = 1, 0
    for r in counts.groupBy(step.alias("n")).count().orderBy(F.desc("n")).collect():  # some 10,000 rows at most
        total += r["count"]
        if total > size:
            least = r.n + 1
            break
    return counts.where(F.col("n") >= least).select(F.replace("word", F.lit(" "), F.lit(MARK)).alias("word"))


def lattice(words: DataFrame, pieces: Pieces, *, size: int = VOCABULARY) -> DataFrame:
    """(word, edges): every piece that is a substring of the word, and the byte spelling of characters without one.

    Words, size of them at most, are dealt out before they are exploded, so that a word's edges are grouped where they are made: words are shuffled, edges aren't.
    """
    spark = words.sparkSession
    words = words.repartition(-(-size // LATTICE_WORDS), "word")
    table = F.broadcast(spark.createDataFrame(list(zip(pieces.text, pieces.ids, pieces.scores, strict=True)), "sub string, id int, score double"))  # the model's fixed number of pieces
    n = F.char_length("word")
    spans = words.select("word", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("start", "_")).select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start")))).alias("size"))
    subs = spans.withColumn("sub", F.substring("word", F.col("start") + 1, F.col("size")))
    edges = subs.join(table, "sub", "left").where("id is not null or size = 1")
    hexed = F.hex(F.encode("sub", "UTF-8"))
    if pieces.byte_ids:
        byte_table = F.split(F.lit(",".join(map(str, pieces.byte_ids))), ",")
        spelled = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda k: F.get(byte_table, F.conv(F.substring(hexed, k, F.lit(2)), 16, 10).cast("int")).cast("int"))
    else:
        spelled = F.array(F.lit(pieces.unknown))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled)
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", F.coalesce("score", F.lit(pieces.fallback)).alias("score"), ids.alias("ids"))
    return edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def viterbi(edges: Column, n: Column) -> Column:
    """ids of the best path over the edges from 0 to n; of equal paths the one with the longer last piece."""
    ends = F.transform(F.sequence(F.lit(1), n), lambda j: F.filter(edges, lambda e: e["end"] == j))
    nothing = F.expr("cast(array() as array<int>)")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(0).alias("at"), nothing.alias("ids")))
    reach = lambda st, es: F.array_max(F.transform(es, lambda e: F.struct((F.get(st, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"), e["start"].alias("at"), e["ids"].alias("ids"))))
    best = F.aggregate(ends, start, lambda st, es: F.concat(st, F.array(reach(st, es))))
    walk = lambda b, _: F.when(b["at"] == 0, b).otherwise(F.struct(F.get(b["best"], b["at"])["at"].alias("at"), F.concat(F.get(b["best"], b["at"])["ids"], b["ids"]).alias("ids"), b["best"].alias("best")))
    return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), nothing.alias("ids"), best.alias("best")), walk)["ids"]


class Speller(dict):
    """Words (UTF-8, spaces for marks) to their ids (four bytes each); words beyond the vocabulary are folded when they are met."""

    def __init__(self, known: Iterable[tuple[bytes, bytes]], pieces: Pieces) -> None:
        super().__init__(known)
        import ahocorasick

        self.pieces, self.most = pieces, len(self) + REMEMBERED
        # All pieces in one walk through a word: its edges by their ends, at each the longest first.
        self.found = ahocorasick.Automaton()
        for text, i, score in zip(pieces.text, pieces.ids, pieces.scores, strict=True):
            self.found.add_word(text, (len(text), i, score))
        self.found.make_automaton()
        self.chars = {p for p in pieces.text if len(p) == 1}

    def _edges(self, word: str) -> Iterable[tuple[int, tuple[int, int, float]]]:
        """(index of the last character, (characters, id, score)) by ends, the longest first; characters without a piece have the id -1."""
        found = self.found.iter(word) if len(self.found) else ()
        if self.chars.issuperset(word):
            return found
        single = [(k, (1, -1, self.pieces.fallback)) for k, c in enumerate(word) if c not in self.chars]
        return sorted([*found, *single], key=lambda e: (e[0], -e[1][0]))

    def __missing__(self, key: bytes) -> bytes:
        word = key.decode().replace(" ", MARK)
        at = len(word) - 1
        score, back = [float("-inf")] * (at + 1) + [0.0], [(1, -1, 0.0)] * (at + 1)  # by the last character; before the first is index -1, the last entry
        for end, edge in self._edges(word):
            s = score[end - edge[0]] + edge[2]
            if s > score[end]:  # of equal paths the earlier start, so the longer piece, stands
                score[end], back[end] = s, edge
        ids: list[int] = []
        while at >= 0:
            size, i, _ = back[at]
            ids += (i,) if i >= 0 else reversed(self.pieces.spelled(word[at]))
            at -= size
        out = array("i", reversed(ids)).tobytes()
        if len(self) < self.most and len(key) <= LONGEST:
            self[key] = out
        return out


def _cut(whole: bytes, ends: np.ndarray) -> Iterator[bytes]:
    at = 0
    for end in ends.tolist():
        yield whole[at:end]
        at = end


def _spell(shared, text_at: int):
    def make():
        speller = getattr(shared, "speller", None)  # a worker process keeps it beside the broadcast, for its next tasks
        if speller is None:
            words, ends, codes, sizes, pieces = shared.value
            speller = shared.speller = Speller(zip(_cut(words, ends), _cut(codes, 4 * np.cumsum(sizes, dtype=np.int64)), strict=True), pieces)
            del words, ends, codes, sizes
            give_back()
        spelled = speller.__getitem__

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text_at)
            parts = [b"".join(map(spelled, words)) if words else b"" for words in _words_of(texts)]
            off = np.r_[0, np.cumsum([len(p) // 4 for p in parts])].astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(parts), np.int32)), mask=texts.is_null())]

        return step

    return make


def encode(docs: DataFrame, pieces: Pieces, *, vocabulary: int = VOCABULARY) -> tuple[DataFrame, str]:
    """docs with one column more (its name is returned too): the ids of text, an array of int.

    A null text has null, an empty one no ids. Spaces become word marks and one is put
    before the text, as the models do. Of two best paths the one whose last piece is
    longer is taken, at every place. Other columns pass through; repeated rows are alike.
    """
    name = fresh_name(docs, "ids")
    vocab = _vocabulary(docs, vocabulary)
    edges = stored(lattice(vocab, pieces, size=max(1, vocabulary)), "lattice")
    spelled = edges.select("word", viterbi(F.col("edges"), F.char_length("word")).alias("ids")).toArrow()  # vocabulary rows at most
    ids = spelled.column("ids").combine_chunks()
    words = spelled.column("word").combine_chunks()
    words = pc.replace_substring(words, MARK, " ").cast(pa.large_binary())
    ends = np.cumsum(np.asarray(pc.binary_length(words), dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast((b"".join(words.to_pylist()), ends, np.asarray(ids.flatten(), np.int32).tobytes(), np.asarray(ids.value_lengths(), np.int32), pieces))
    del spelled, ids, words, ends
    give_back()
    return by_partition(docs, _spell(shared, docs.columns.index("text")), T.StructType([T.StructField(name, T.ArrayType(T.IntegerType()))])), name


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of ids: their pieces' bytes end to end, without the mark that encoding put first."""
    table = F.split(F.lit(",".join(b.hex() for b in pieces.decoded)), ",")
    text = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
    return F.when(F.startswith(text, F.lit(" ")), F.substr(text, F.lit(2))).otherwise(text)


def round_trip(docs: DataFrame, pieces: Pieces, **options) -> DataFrame:
    """One row per document: doc_id, ids, n_ids, and same: whether decoding gives the text back.

    A word mark in a text decodes to a space (they are one character to these models), so
    the text is compared with its marks made spaces. A null text has null ids and same true.
    """
    out, ids = encode(docs.select("doc_id", "text"), pieces, **options)
    same = decode(F.col(ids), pieces).eqNullSafe(F.replace("text", F.lit(MARK), F.lit(" ")))
    return out.select("doc_id", F.col(ids).alias("ids"), F.when(F.col(ids).isNull(), 0).otherwise(F.size(ids)).cast("long").alias("n_ids"), same.alias("same"))


def with_ids(docs: DataFrame, pieces: Pieces, **options) -> DataFrame:
    """docs with ids, n_ids and same (or such names with a number, where docs has them)."""
    out, ids = encode(docs, pieces, **options)
    out = out.withColumn(fresh_name(out, "n_ids"), F.when(F.col(ids).isNull(), 0).otherwise(F.size(ids)).cast("long"))
    return out.withColumn(fresh_name(out, "same"), decode(F.col(ids), pieces).eqNullSafe(F.replace("text", F.lit(MARK), F.lit(" "))))
