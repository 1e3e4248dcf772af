"""Repeated byte strings, found with suffix arrays of shards.

Any two equal 100-byte strings have the same minimal 20-byte gram in them (winnowing), at
the same place. A document's minimal grams are its anchors; the strings of which an anchor
is the minimal gram follow each other, and together are its context. Each string is in one
context. Contexts whose anchor occurs more than once
are sharded by anchor, so equal strings meet in one shard; an anchor with very many
contexts is split over more shards. Each shard sorts its distinct contexts' suffixes with
Larsson-Sadakane refinement and gets their common prefixes with Kasai's bound; strings
that an earlier one equals are repeated. The first strings of the shards of one split
anchor are sorted runs of bytes, which are merged two by two by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import NO_ID, Known, Prefix, by_partition, chunks, discard, expand, fresh_name, mix, runs, small_lists, stored, utf8

LENGTH, GRAM = 100, 20
#: Contexts of one anchor that one shard takes, and the bytes of contexts that are sorted at once.
SHARD_ROWS, SHARD_BYTES = 8192, 1 << 19
#: Parts in which the first strings of one shard are merged with those of the others, and first strings that are merged at once.
MERGE_BUCKETS, MERGE_ROWS = 32, 50_000
#: Repeated anchors that are sent to every executor (4 bytes each); more are joined.
SENT_ANCHORS = 12_000_000

_U = np.uint64


def anchors(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each context, and the hash of its anchor: the gram that is the first least one of each of its strings."""
    size = np.diff(off)
    long_enough = np.flatnonzero(size >= length)
    if not len(long_enough):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(raw) - gram + 1
    at = np.arange(n)
    h = Prefix(raw).of(at, at + gram)
    low = _U(32)
    key = (h >> low << low) | at.astype(np.uint64)
    width, reach = 1, length - gram + 1
    while width * 2 <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
    starts = expand(off[:-1][long_enough], size[long_enough] - length + 1)[0]
    best = (key[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return starts[first], starts[np.r_[first[1:], len(best)] - 1] + length, h[best[first]]


def _heads(text: np.ndarray, left: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """The first bytes of each suffix as one number below 2^room, and how many they are. An end is 0, bytes are numbered from 1."""
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    width = len(used).bit_length()
    size = max(1, room // max(1, width))
    part, key, have, span = code[text], np.zeros(len(text), np.uint64), 0, 1
    while True:  # part holds `span` bytes; the binary digits of size say which parts make the key
        if size & span:
            more = np.zeros_like(part)
            more[: len(part) - have] = part[have:]
            key = (key << _U(span * width)) | np.where(left > have, more, _U(0))
            have += span
        if 2 * span > size:
            return key, size
        more = np.zeros_like(part)
        more[: len(part) - span] = part[span:]
        part = (part << _U(span * width)) | np.where(left > span, more, _U(0))
        span *= 2


def _sorted_by(major: np.ndarray, minor: np.ndarray, items: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """minor and items in the order of (major, minor, item); by one sort of packed words while they fit."""
    if 3 * bits <= 64:
        packed = (major.astype(np.uint64) << _U(2 * bits)) | (minor.astype(np.uint64) << _U(bits)) | items.astype(np.uint64)
        packed.sort()
        low = _U((1 << bits) - 1)
        return ((packed >> _U(bits)) & low).astype(np.int64), (packed & low).astype(np.int64)
    order = np.lexsort((items, minor, major))
    return minor[order], items[order]


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of a byte array in order; each ends after `left` bytes, and an end is smaller than any byte.

    Larsson-Sadakane: ranks start from the first bytes, and each round doubles the length
    by which suffixes are sorted, but only within groups that are still equal, by the
    rank of what follows. Equal suffixes stay in text order.
    """
    n = len(text)
    bits = max(2, (n + 2).bit_length())
    key, h = _heads(text, left, 64 - bits)
    packed = (key << _U(bits)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    sa = (packed & _U((1 << bits) - 1)).astype(np.int64)
    ordered, ended = packed >> _U(bits), left[sa] < h
    # A suffix that has ended stands by itself, in text order among its equals.
    new = np.r_[True, ordered[1:] != ordered[:-1]] | ended if n else np.zeros(0, bool)
    rank = np.full(n + 1, -1, np.int64)
    place, own = np.arange(n), sa
    while True:  # place: where the suffixes stand whose groups were open; own: those suffixes
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(place)])
        group = np.repeat(place[first], size)
        rank[own] = group
        still = np.repeat(size > 1, size)
        place, group, own = place[still], group[still], own[still]
        if not len(place):
            return sa
        # What follows an ended suffix ranks 0; the others' ranks move up by one.
        follow, own = _sorted_by(group, np.where(left[own] > h, rank[np.minimum(own + h, n)] + 1, 0), own, bits)
        sa[place] = own
        new = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])] | (follow == 0)
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, left: np.ndarray, cap: int) -> np.ndarray:
    """For each suffix in sa (all of which have cap bytes left) the common prefix with the one before, up to cap.

    Kasai's bound in text order, 16 positions apart at once: a suffix shares with its
    predecessor at least one byte less than the suffix one position earlier did, as long
    as the suffix after that one's predecessor is in sa too. Bytes are compared by eights.
    """
    n, stride = len(text), 16
    before = np.full(n + 1, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)[:n].copy().view(np.uint64).reshape(-1)
    inside = np.append(left >= cap, False)
    out = np.zeros(n, np.int64)
    mine = np.flatnonzero(before[:n] >= 0)
    mine = mine[np.argsort((mine % stride).astype(np.uint8), kind="stable")]
    for i in np.split(mine, np.searchsorted(mine % stride, np.arange(1, stride))):
        j, past = before[i], before[i - 1]
        lcp = np.where((i > 0) & (past >= 0) & inside[past + 1], np.maximum(0, out[i - 1] - 1), 0)
        live = np.flatnonzero(lcp < cap)
        while len(live):
            apart = eight[i[live] + lcp[live]] ^ eight[j[live] + lcp[live]]
            same = apart == 0
            lcp[live] += np.where(same, 8, np.bitwise_count((apart & (~apart + _U(1))) - _U(1)) >> 3)
            live = live[same]
            live = live[lcp[live] < cap]
        out[i] = np.minimum(lcp, cap)
    return out[sa]


def _firsts(group: np.ndarray, ids: np.ndarray, ts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest row of each group, and which rows start where their group's earliest does (a string may be in several contexts)."""
    order = np.lexsort((starts, ts, ids))
    _, at, number = np.unique(group[order], return_index=True, return_inverse=True)
    first = order[at]
    of = np.empty(len(group), np.int64)
    of[order] = first[number]
    return first, (ids == ids[of]) & (ts == ts[of]) & (starts == starts[of])


def _count(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(0))
            found = [anchors(raw[off[a] : off[b]], off[a : b + 1] - off[a], length, gram)[2] for a, b in chunks(off)]
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["a", "n"])

    return run


def _all_anchors(length: int, gram: int):
    """(id, t, text) to a row for each context: id, t, lo, hi, a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(2))
            for a, b in chunks(off):
                o = off[a : b + 1] - off[a]
                lo, hi, h = anchors(raw[off[a] : off[b]], o, length, gram)
                doc = np.searchsorted(o, lo, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), batch.column(1).take(pa.array(doc + a)), pa.array(lo - o[doc]), pa.array(hi - o[doc]), pa.array(h.view(np.int64))], names=["id", "t", "lo", "hi", "a"])

    return run


_CONTEXT = "a long, n long, salt int, id long, t long, start long, ctx binary"


def _cut_contexts(batch_ids, batch_ts, raw, off, doc, lo, hi, h, n) -> pa.RecordBatch:
    """Contexts (text number, start and end in raw, the anchor's hash and occurrences) with their bytes."""
    ids, ts = batch_ids.take(pa.array(doc)), batch_ts.take(pa.array(doc))
    # Each place has its salt, so that a split anchor's shards are even if one text has most of its occurrences.
    own = np.asarray(ids, dtype=np.int64).view(np.uint64) ^ mix(np.asarray(ts, dtype=np.int64).view(np.uint64) + (lo - off[doc]).astype(np.uint64))
    salt = (mix(own) % np.maximum(1, -(-n // SHARD_ROWS)).astype(np.uint64)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(hi - lo)])
    data = raw[expand(lo, hi - lo)[0]]
    ctx = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(salt.astype(np.int32)), ids, ts, pa.array(lo - off[doc]), ctx], names=["a", "n", "salt", "id", "t", "start", "ctx"])


def _known_contexts(shared, length: int, gram: int):
    """(id, t, text) to contexts, by what every executor has of the repeated anchors.

    That is the upper halves of their hashes; an anchor that shares its half with a repeated
    one gives a context too many, which meets no equal. Those that are split are known in full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, keys, counts = shared.value
        halves, split = Known(halves), Known(keys)
        for batch in batches:
            raw, off = utf8(batch.column(2))
            for a, b in chunks(off, CONTEXT_BYTES):
                part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                lo, hi, h = anchors(part, o, length, gram)
                hit, _ = halves.find((h >> _U(32)).astype(np.uint32))
                lo, hi, h = lo[hit], hi[hit], h[hit]
                n = np.ones(len(h), np.int64)
                at, key = split.find(h)
                n[at] = counts[key]
                doc = np.searchsorted(o, lo, "right") - 1
                yield _cut_contexts(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), part, o, doc, lo, hi, h, n)

    return run


#: Text whose contexts go out as one batch.
CONTEXT_BYTES = 1 << 20


def _joined_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, text, marks array of (lo, hi, a, n)) to contexts."""
    for batch in batches:
        raw, off = utf8(batch.column(2))
        marks = batch.column(3)
        begin = np.r_[0, np.cumsum(np.asarray(marks.value_lengths()))]
        flat = marks.flatten()
        lo, hi, h, n = (np.asarray(flat.field(k), dtype=np.int64) for k in range(4))
        for a, b in chunks(off, CONTEXT_BYTES):
            s = slice(int(begin[a]), int(begin[b]))
            doc = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))
            o = off[a : b + 1] - off[a]
            yield _cut_contexts(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), raw[off[a] : off[b]], o, doc, lo[s] + o[doc], hi[s] + o[doc], h[s].view(np.uint64), n[s])


_FOUND = "id long, t long, s long, e long, a long, bucket int, salt int, string binary"


def _found(ids, ts, s, e, a=None, bucket=None, salt=None, string=None) -> pa.RecordBatch:
    """Spans that go (bucket -1), or first strings on their way to the merge."""
    zero = np.zeros(len(ids), np.int64)
    string = pa.nulls(len(ids), pa.binary()) if string is None else string
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ts), pa.array(s), pa.array(e), pa.array(zero if a is None else a), pa.array((zero - 1 if bucket is None else bucket).astype(np.int32)), pa.array((zero if salt is None else salt).astype(np.int32)), string], names=["id", "t", "s", "e", "a", "bucket", "salt", "string"])


def _shard(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """One shard's repeated spans (bucket -1), and the first strings of split anchors for the merge."""
    ids, ts, start, a, n, salt = (np.asarray(t.column(c), dtype=np.int64) for c in ("id", "t", "start", "a", "n", "salt"))
    ctx = t.column("ctx").combine_chunks()
    begin = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
    size, raw = np.diff(begin), np.frombuffer(ctx.buffers()[2], np.uint8)
    keep, first = _firsts(np.asarray(pc.dictionary_encode(ctx).indices), ids, ts, start)
    # An earlier context is the same: all of this one is repeated.
    yield _found(ids[~first], ts[~first], start[~first], start[~first] + size[~first])
    # The distinct contexts are sorted, each where it is first.
    own, owner = expand(begin[:-1][keep], size[keep])
    left = np.repeat(size[keep], size[keep]) - (own - begin[:-1][keep][owner])
    text = raw[own]
    sa = suffix_array(text, left)
    sa = sa[left[sa] >= length]
    if not len(sa):
        return
    # Equal strings are neighbours; the place of each is its text's rank with its start in there.
    head = np.flatnonzero(common_prefixes(text, sa, left, length) < length)
    size_of = np.diff(np.r_[head, len(sa)])
    by_text = np.lexsort((ts, ids))
    rank = np.empty(len(ids), np.int64)
    rank[by_text] = np.cumsum(np.r_[0, (np.diff(ids[by_text]) != 0) | (np.diff(ts[by_text]) != 0)])
    place = (rank[keep] << 32) + start[keep] - begin[:-1][keep]
    place = place[owner[sa]] + own[sa]
    once = place == np.repeat(np.minimum.reduceat(place, head), size_of)
    # Neighbouring repeated strings make one span.
    gone = np.zeros(len(text), bool)
    gone[sa[~once]] = True
    g = np.flatnonzero(gone)
    if len(g):
        new = np.r_[True, (np.diff(g) != 1) | (owner[g][1:] != owner[g][:-1])]
        at = np.flatnonzero(new)
        first, last = g[at], g[np.r_[at[1:], len(g)] - 1]
        c = keep[owner[first]]
        yield _found(ids[c], ts[c], own[first] - begin[:-1][c] + start[c], own[last] - begin[:-1][c] + start[c] + length)
    # The first of each group of equal strings goes on to the merge, once for each split anchor that it is near.
    many = n > SHARD_ROWS
    if many.any():
        w, group = sa[once], np.repeat(np.arange(len(head)), size_of)[once]
        sent = many[keep[owner[w]]]
        w, group = w[sent], group[sent]
        c = keep[owner[w]]
        order = np.lexsort((a[c], group))
        w, group, c = w[order], group[order], c[order]
        one = np.r_[True, (group[1:] != group[:-1]) | (a[c][1:] != a[c][:-1])][: len(w)]
        w, c = w[one], c[one]
        at = own[w] - begin[:-1][c] + start[c]
        strings = np.lib.stride_tricks.sliding_window_view(raw, length)[own[w]] if len(w) else np.zeros((0, length), np.uint8)
        bucket = (Prefix(raw).of(own[w], own[w] + length) % (MERGE_BUCKETS * -(-n[c] // SHARD_ROWS)).astype(np.uint64)).astype(np.int64)
        offsets = pa.py_buffer(np.arange(0, (len(w) + 1) * length, length, dtype=np.int32))
        yield _found(ids[c], ts[c], at, at + length, a[c], bucket, salt[c], pa.Array.from_buffers(pa.binary(), len(w), [None, offsets, pa.py_buffer(np.ascontiguousarray(strings))]))


def _held(batches: Iterator[pa.RecordBatch], keys: list[str], weigh, limit: int) -> Iterator[pa.Table]:
    """Runs of whole groups (rows come sorted by keys), of limit or somewhat more."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        weight += weigh(batch)
        if weight < limit:
            continue
        table = pa.Table.from_batches(held)
        k = [np.asarray(table.column(c)) for c in keys]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        if not len(change):
            continue
        # Cut at a group's end near each multiple of the limit.
        share = np.arange(limit, weight + 1, limit) * table.num_rows // max(1, weight)
        cuts = np.unique(change[np.minimum(np.searchsorted(change, share), len(change) - 1)])
        for lo, hi in zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True):
            yield table.slice(lo, hi - lo)
        rest = table.slice(int(cuts[-1]))
        held = rest.combine_chunks().to_batches()
        weight = sum(weigh(b) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, ["a", "salt"], lambda b: int(pc.sum(pc.binary_length(b.column(6))).as_py() or 0), SHARD_BYTES):
            yield from _shard(table, length)

    return run


def _merged(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of (string, row) as one; of equal strings the smaller row stays and the other is marked gone."""
    at = np.searchsorted(x[0], y[0])  # binary search of the one run's strings in the other
    there = np.minimum(at, len(x[0]) - 1)
    same = np.flatnonzero(x[0][there] == y[0])
    mine, theirs = x[1][there[same]], y[1][same]
    gone[np.maximum(mine, theirs)] = True
    x[1][there[same]] = np.minimum(mine, theirs)
    rest = np.ones(len(at), bool)
    rest[same] = False
    return np.insert(x[0], at[rest], y[0][rest]), np.insert(x[1], at[rest], y[1][rest])


def _merge(length: int):
    """First strings of the shards of one anchor to those that another shard has earlier: sorted runs are merged two by two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, ["a", "bucket"], lambda b: b.num_rows, MERGE_ROWS):
            ids, ts, s, e, a, bucket, salt = (np.asarray(table.column(c), dtype=np.int64) for c in ("id", "t", "s", "e", "a", "bucket", "salt"))
            order = np.lexsort((s, ts, ids, bucket, a))  # a group's rows by where they start: the smaller, the earlier
            ids, ts, s, e, a, bucket, salt = (x[order] for x in (ids, ts, s, e, a, bucket, salt))
            words = table.column("string").combine_chunks()
            begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
            words = np.frombuffer(words.buffers()[2], np.uint8)[begin : begin + length * len(s)].reshape(-1, length)[order]
            # Runs hold the strings of one shard number, of each anchor by itself.
            head = np.stack([a.view(np.uint64) ^ _U(1 << 63), bucket.astype(np.uint64)], 1).astype(">u8").view(np.uint8).reshape(len(s), 16)
            keys = np.concatenate([head, words], 1).view(f"S{16 + length}").reshape(-1)
            gone, runs_ = np.zeros(len(s), bool), []
            by_salt = np.argsort(salt, kind="stable")
            for rows in np.split(by_salt, np.flatnonzero(np.diff(salt[by_salt])) + 1) if len(s) else ():
                strings, first, of = np.unique(keys[rows], return_index=True, return_inverse=True)
                gone[rows] = first[of] != np.arange(len(rows))  # one shard may have been sorted in parts
                runs_.append((strings, rows[first]))
            while len(runs_) > 1:
                runs_ = [_merged(runs_[k], runs_[k + 1], gone) if k + 1 < len(runs_) else runs_[k] for k in range(0, len(runs_), 2)]
            # A place that was sent more than once is gone only where an earlier place has its string.
            earliest = _earliest(gone, a, bucket, ids, ts, s)
            yield _found(ids[earliest], ts[earliest], s[earliest], e[earliest])

    return run


def _earliest(gone: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Rows that are gone, without those whose group and place are those of a row that stays."""
    new = np.r_[True, np.any([np.diff(x) != 0 for x in place], axis=0)] if len(gone) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    stays = np.zeros(len(gone), bool)
    stays[number[~gone]] = True
    return np.flatnonzero(gone & ~stays[number])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans sorted, and made one where they overlap or touch."""
    for batch in batches:
        n = np.asarray(batch.column(2).value_lengths(), dtype=np.int64)
        flat = batch.column(2).flatten()
        s, e = (np.asarray(flat.field(k), dtype=np.int64) for k in range(2))
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((s, row))
        s, e, row = s[order], e[order], row[order]
        shift = row * (int(e.max()) + 1 if len(e) else 1)
        reach = np.maximum.accumulate(e + shift) - shift
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (s[1:] > reach[:-1])]) if len(s) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(s)] - 1 if len(s) else new
        begin = np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(n)))].astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(s[new]), pa.array(reach[last])], ["s", "e"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(begin), spans)], names=["id", "t", "spans"])


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, t, spans): for each text with repeated strings the spans [s, e) of its bytes that they cover."""
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= length).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t"), "text")
    counts = texts.select("text").mapInArrow(_count(length, gram), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(counts, "anchors")
    if counts.count() <= SENT_ANCHORS:
        halves = np.unique(np.asarray(counts.select(F.shiftright("a", 32).cast("int")).toArrow().column(0), dtype=np.int32).view(np.uint32))
        split = counts.where(F.col("n") > SHARD_ROWS).toArrow()
        keys = np.asarray(split.column("a"), dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((halves, keys[order], np.asarray(split.column("n"), dtype=np.int64)[order]))
        contexts = texts.mapInArrow(_known_contexts(shared, length, gram), _CONTEXT)
    else:
        # An anchor with very many occurrences makes a skewed join, which adaptive execution splits.
        marks = texts.mapInArrow(_all_anchors(length, gram), "id long, t long, lo long, hi long, a long").join(counts, "a")
        marks = marks.groupBy("id", "t").agg(F.collect_set(F.struct("lo", "hi", "a", "n")).alias("marks"))
        contexts = texts.join(marks, ["id", "t"]).select("id", "t", "text", "marks").mapInArrow(_joined_contexts, _CONTEXT)
    sharded = contexts.repartition("a", "salt").sortWithinPartitions("a", "salt")
    found = stored(sharded.mapInArrow(_shards(length), _FOUND), "found")
    split = found.where("bucket >= 0").repartition("a", "bucket").sortWithinPartitions("a", "bucket").mapInArrow(_merge(length), _FOUND)
    gone = found.where("bucket < 0").union(split)
    lists = gone.groupBy("id", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = stored(lists.mapInArrow(_united, "id long, t long, spans array<struct<s:long,e:long>>"), "spans")
    discard(counts, found)
    return spans


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _remove(text_at: int, spans_at: int, digest: bool):
    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            raw, off = utf8(batch.column(text_at))
            lists = batch.column(spans_at)
            n = np.asarray(lists.fill_null([]).value_lengths() if lists.null_count else lists.value_lengths(), dtype=np.int64)
            flat = lists.flatten()
            begin = np.r_[0, np.cumsum(n)]
            s, e = (np.asarray(flat.field(k), dtype=np.int64) for k in range(2))
            size, removed, spans, kept = np.diff(off), [], [], []
            for k in range(len(off) - 1):
                text = raw[off[k] : off[k + 1]]
                if n[k]:
                    cover = np.zeros(len(text) + 1, np.int64)
                    np.add.at(cover, s[begin[k] : begin[k + 1]], 1)
                    np.add.at(cover, e[begin[k] : begin[k + 1]], -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    removed.append(int(gone.sum()))
                    spans.append(len(runs(gone)[0]))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(hashlib.sha256(text).hexdigest().encode() if digest else text.tobytes())
            return [pa.StructArray.from_arrays([pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])]

        return step

    return make


def remove_repeats(docs: DataFrame, *, digest: bool = False, **options) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name is returned too): n_bytes, n_removed, n_spans and the kept bytes.

    A byte goes if a string of `length` bytes over it also starts earlier: in a smaller
    doc_id, or earlier in the same text. Strings are judged on the input and never cross
    texts; a null or short text stays as it is. A null doc_id comes before all others;
    texts under one doc_id follow each other in a fixed order, and rows that repeat
    both id and text are one document. With digest, kept is the SHA-256 of the kept
    bytes in hex. Other columns pass through.
    """
    gone = repeated_spans(docs, **options).select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("spans").alias("_spans"))
    on = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_t"))
    joined = docs.join(small_lists(gone, "_spans"), on, "left")
    name = fresh_name(docs, "repeats")
    source = joined.select(*(docs[c] for c in docs.columns), "_spans")
    out = by_partition(source, _remove(docs.columns.index("text"), len(docs.columns), digest), T.StructType([T.StructField(name, RESULT)]))
    return out.drop("_spans"), name


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out, r = remove_repeats(docs.select("doc_id", "text"), digest=True, **options)
    return out.select("doc_id", F.col(r)["n_bytes"].alias("n_bytes"), F.col(r)["n_removed"].alias("n_removed"), F.col(r)["n_spans"].alias("n_spans"), F.col(r)["kept"].cast("string").alias("kept_sha256"))
