"""Substring dedup by recompression.

A window is ``WINDOW`` consecutive words of one text.  A word is removed when a
window that covers it also starts, word for word, in a document with a smaller
id; windows are judged on the input, not on what is left.

*Rounds.*  A text is a sequence of word names.  Round 0 replaces every maximal
run of one name by a symbol (runs of ``LONG`` or more by one symbol for any
length); each later round splits the alphabet in two by a bit of the symbol's
name and replaces every pair left-right by a new symbol.  A new symbol's name is
a 64-bit digest of what it replaces, so all executors give equal runs and pairs
one global name without a dictionary, and the rounds need no shuffle.  Symbols
of ``LONG`` words or more take no further part.  Whether there is a symbol
boundary at a word then depends on the ``LOSS`` words on either side only, so
equal substrings have the same boundaries but for their outermost ``LOSS`` words.

*Reveal.*  Every window has an anchor: of the symbol boundaries within its
consistent interior, the one whose *phrase*, the symbols that lie in the
``PHRASE`` words from there on, has the least name.  A phrase's name is a digest
of its symbols, and it lies in the interior with all of them, so it depends on the
window's words only and two equal windows meet at it.  Consecutive windows with
one phrase are one row (a passage that repeats a few words over and over is one,
too), shuffled once by the phrase's name.

*Combine.*  Of equal windows in one batch of documents, all but those with the
smallest id are removed there and then: whatever other batches hold, a smaller id
has them.  Only the others are shuffled, so a passage that a third of all
documents share sends each of its windows once for each batch, not for each document.

*Verify.*  Rows that meet compare their windows' names; the smallest id having
each window decides.  A phrase of more than ``CROWD`` rows is not compared in
one place: its windows go on to a grouped minimum and a join instead.

Names are 64-bit and the words themselves are not compared again: a phrase with
N distinct windows has about N^2 / 2^65 false equalities (1e-5 at 20 million),
the only way a result can differ from a word-for-word comparison.

Defined results: null or blank text has no words; a text shorter than a window
keeps all; rows that repeat an id never remove from each other; a null id
neither removes nor loses words; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import texts_of
from .shared import write_table
from .words import chunks, mix, powers, split_words, whole, window_names

WINDOW = 50
ROUNDS = 3
LONG = 4
#: Words from a window's edge within which boundaries may depend on what is outside.
LOSS = (LONG - 1) * (ROUNDS + 1)
PHRASE = 12
#: Text of a batch whose equal windows are combined before they are shuffled.
COMBINE_BYTES = 6 << 20
#: Rows of one phrase that a task compares at once, and windows that it remembers of a phrase with more.
CROWD = 1 << 16
CROWD_WINDOWS = 1 << 21

_U = np.uint64
_FAR = _U(0xFFFFFFFFFFFFFFFF)


def symbols(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that are left after all rounds: first word, name and number of words of each."""
    if not len(names):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(names)))
    symbol = mix(names[start] + np.minimum(size, LONG).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    own = doc[start]
    for r in range(1, rounds + 1):
        right = (mix(symbol + _U(r * 0x632BE59B)) & _U(1)) == 1
        short = size < LONG
        pair = np.flatnonzero(~right[:-1] & right[1:] & short[:-1] & short[1:] & (own[:-1] == own[1:]))
        symbol[pair] = mix(symbol[pair] * _U(0xD1342543DE82EF95) + symbol[pair + 1] + _U(r))
        size[pair] += size[pair + 1]
        left = np.ones(len(symbol), dtype=bool)
        left[pair + 1] = False
        symbol, size, start, own = symbol[left], size[left], start[left], own[left]
    return start, symbol, size


def phrase_names(start: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each symbol, a digest of the symbols from it on that end within ``PHRASE`` words (its own at least)."""
    first = np.arange(len(start))
    after = np.maximum(np.searchsorted(start + size, start + PHRASE, side="right"), first + 1)
    up, down = powers(len(start) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(symbol * up[: len(start)], dtype=np.uint64)))
    return mix((sums[after] - sums[first]) * down[: len(start)] + (after - first).astype(np.uint64))


def anchors(n_words: int, starts: np.ndarray, at: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, whether it has an anchor, and the name of the anchor's phrase."""
    worth = np.full(n_words + WINDOW, _FAR, dtype=np.uint64)
    worth[at] = phrases
    reach, span = 1, WINDOW - 2 * LOSS - PHRASE + 1  # the phrase lies in the interior
    while reach < span:  # the least within ``reach`` words from each word on
        step = min(reach, span - reach)
        worth = np.minimum(worth[: len(worth) - step], worth[step:])
        reach += step
    found = worth[starts + LOSS]
    return found != _FAR, found


def anchored_rows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, phrase name, first window, windows of each row, all windows' names) chunk by chunk."""
    for a, b in chunks([len(t) for t in texts]):
        w = split_words(texts[a:b])
        starts = whole(w.offsets, WINDOW)
        if not len(starts):
            continue
        doc = w.docs()
        at, symbol, size = symbols(w.names, doc)
        has, phrase = anchors(len(w.names), starts, at, phrase_names(at, symbol, size))
        windows = window_names(w.names, WINDOW)[starts]
        key = np.where(has, phrase, windows)
        own = doc[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        yield a + own[first], key[first], starts[first] - w.offsets[own[first]], np.diff(np.append(first, len(starts))), windows


def combined(key: np.ndarray, ids: np.ndarray, at: np.ndarray, counts: np.ndarray, windows: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Rows of a batch (phrase, id, mark and first window, windows) as rows still to compare, and spans (id, mark and first, last) that a smaller id of the batch has."""
    order = np.lexsort((ids, key))
    ends = np.cumsum(counts)
    place = np.repeat((ends - counts)[order] - np.concatenate(([0], np.cumsum(counts[order])[:-1])), counts[order]) + np.arange(len(windows))
    key, ids, at, counts, windows = key[order], ids[order], at[order], counts[order], windows[place]
    removed = removed_windows(key, ids, counts, windows)
    row, first, last = spans_of(at & 0xFFFFFFFF, counts, removed)
    gone = ids[row], at[row] >> 32 << 32 | first, last
    row, first, last = spans_of(at & 0xFFFFFFFF, counts, ~removed)
    return (key[row], ids[row], at[row] >> 32 << 32 | first, last - first + 1, windows[~removed]), gone


def removed_windows(key: np.ndarray, ids: np.ndarray, counts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For rows sorted by (key, id): which windows a smaller id has under the same key."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    out = np.zeros(len(windows), dtype=bool)
    met = np.repeat(np.bincount(group)[group] > 1, counts)
    if not met.any():
        return out
    at = np.flatnonzero(met)
    row = np.repeat(np.arange(len(key)), counts)[at]
    name = windows[at]
    both = (group[row].astype(np.uint64) << _U(32)) | (name >> _U(32))
    order = np.argsort(both, kind="stable")
    head = np.ones(len(order), dtype=bool)
    head[1:] = both[order][1:] != both[order][:-1]
    if (~head[1:] & (name[order][1:] != name[order][:-1])).any():  # half a name isn't enough here
        order = np.lexsort((name, group[row]))
        head[1:] = (group[row[order]][1:] != group[row[order]][:-1]) | (name[order][1:] != name[order][:-1])
    least = ids[row[order]][head][np.cumsum(head) - 1]
    out[at[order]] = ids[row[order]] > least
    return out


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows to remove, from rows sorted by (key, id); those of a crowd that find no room come with their key and name.

    Rows with a last window are spans that are decided already.
    """
    names = ["id", "mark", "first", "last", "key", "window"]
    none = pa.nulls

    def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
        key, ids, at = (batch.column(k).to_numpy() for k in range(3))
        counts, windows = unpacked(batch.column(3))
        removed = removed_windows(key, ids, counts, windows)
        row, first, last = spans_of(at & 0xFFFFFFFF, counts, removed)
        if len(row):
            n = len(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(at[row] >> 32), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), none(n, pa.int64()), none(n, pa.int64())], names=names)

    def crowd(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """More rows of a crowded phrase: compare with the windows seen so far, ids ascending."""
        nonlocal seen, seen_ids, full
        key, ids, at = (batch.column(k).to_numpy() for k in range(3))
        counts, windows = unpacked(batch.column(3))
        row = np.repeat(np.arange(len(key)), counts)
        place = np.minimum(np.searchsorted(seen, windows), max(len(seen) - 1, 0))
        known = seen[place] == windows if len(seen) else np.zeros(len(windows), dtype=bool)
        removed = np.zeros(len(windows), dtype=bool)
        removed[known] = ids[row[known]] > seen_ids[place[known]]
        rest = np.flatnonzero(~known)
        new, first_at, which = np.unique(windows[rest], return_index=True, return_inverse=True)
        new_ids = ids[row[rest]][first_at]
        full = full or len(seen) + len(new) > CROWD_WINDOWS
        if not full:
            removed[rest] = ids[row[rest]] > new_ids[which]
            order = np.argsort(merged := np.concatenate((seen, new)), kind="stable")
            seen, seen_ids, rest = merged[order], np.concatenate((seen_ids, new_ids))[order], rest[:0]
        where, first, last = spans_of(at & 0xFFFFFFFF, counts, removed)
        n, m = len(where), len(rest)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(ids[where]), pa.array(at[where] >> 32), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), none(n, pa.int64()), none(n, pa.int64())], names=names)
        if m:  # no room for them: each window on its own, all its occurrences alike
            own = (at & 0xFFFFFFFF)[row] + np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
            same = pa.array(own[rest].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[rest]]), pa.array(at[row[rest]] >> 32), same, same, pa.array(key[row[rest]]), pa.array(windows[rest].view(np.int64))], names=names)

    def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        packed = column.to_pylist()
        return np.array([len(x) // 8 for x in packed], dtype=np.int64), np.frombuffer(b"".join(packed), dtype=np.uint64)

    held: list[pa.RecordBatch] = []  # the last key's rows so far
    crowded = False  # they were more than CROWD: only their windows are remembered
    seen, seen_ids = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    full = False  # some windows of this crowd found no room: no more are taken in
    for batch in batches:
        decided = batch.column(4).is_valid()
        if decided.true_count:
            some = batch.filter(decided)
            at, n = some.column(2).to_numpy(), some.num_rows
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array(at >> 32), pa.array((at & 0xFFFFFFFF).astype(np.int32)), some.column(4), none(n, pa.int64()), none(n, pa.int64())], names=names)
            batch = batch.filter(pc.invert(decided))
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held or crowded:
            upto = int(np.searchsorted(key, now, side="right"))
            if upto:
                if crowded:
                    yield from crowd(batch.slice(0, upto))
                else:
                    held.append(batch.slice(0, upto))
            if upto < len(key):
                if held:
                    yield from compared(held)
                held, crowded = [], False
                if last > upto:
                    yield from compared([batch.slice(upto, last - upto)])
                held = [batch.slice(last)]
        else:
            if last:
                yield from compared([batch.slice(0, last)])
            held = [batch.slice(last)]
        now = key[-1]
        if sum(b.num_rows for b in held) > CROWD:
            seen, seen_ids, full = seen[:0], seen_ids[:0], False
            for part in held:
                yield from crowd(part)
            held, crowded = [], True
    if held:
        yield from compared(held)


def spans_of(first: np.ndarray, counts: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of removed windows: (row, first window, last window)."""
    row = np.repeat(np.arange(len(first)), counts)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(row))
    row, at = row[removed], at[removed]
    head = np.ones(len(row), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(head)
    return row[begin], at[begin], at[np.append(begin[1:], len(row)) - 1] if len(row) else at[begin]


def cut(text: bytes, spans: list[int]) -> tuple[int, int, bytes]:
    """Words, words removed, and the text without them; spans hold first and last windows in turn."""
    w = split_words([text])
    n = len(w.names)
    change = np.zeros(n + 1, dtype=np.int64)
    pairs = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1] + WINDOW, -1)
    gone = np.cumsum(change)[:-1] > 0
    parts, last = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        parts.append(text[last : w.starts[a]])
        last = int(w.starts[b]) if b < n else len(text)
    parts.append(text[last:])
    return n, int(gone.sum()), b"".join(parts)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_text`` (the text without the removed words)."""
    return _cut_texts(docs, id_col, text_col, ()).toDF(id_col, "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with their texts cut; null texts become empty."""
    carry = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = _cut_texts(docs, id_col, text_col, carry)
    own = {id_col: "id", text_col: "kept_text"} | {c: f"carried_{i}" for i, c in enumerate(carry)}
    return found.select(*[F.col(own[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _cut_texts(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(id, n_words, n_removed, kept_text) and the columns ``carry`` under names of their own."""
    carried = [f"carried_{i}" for i in range(len(carry))]
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 31) - 1)  # tells texts of one id apart
    own = own.withColumn("mark", mark)

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "at", "windows", "last"]
        for batch in batches:
            all_ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            texts = texts_of(batch.column(1))
            for a, b in chunks([len(t) for t in texts], COMBINE_BYTES):
                found = list(anchored_rows(texts[a:b]))
                if not found:
                    continue
                of, key, first, counts, windows = (np.concatenate(x) for x in zip(*found, strict=True))
                (key, ids, at, counts, windows), gone = combined(key, all_ids[a + of], (marks[a + of] << 32) | first, counts, windows)
                ends = np.cumsum(counts).astype(np.int64) * 8
                named = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(windows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(at), named, pa.nulls(len(key), pa.int32())], names=names)
                if len(gone[0]):  # decided; they travel with the rest, dealt by their ids
                    n = len(gone[0])
                    yield pa.RecordBatch.from_arrays([pa.array(mix(gone[0].astype(np.uint64)).view(np.int64)), pa.array(gone[0]), pa.array(gone[1]), pa.nulls(n, pa.binary()), pa.array(gone[2].astype(np.int32))], names=names)

    rows = own.where("id IS NOT NULL").select("id", "text", "mark").mapInArrow(anchor, "key bigint, id bigint, at bigint, windows binary, last int")
    rows = rows.repartition("key").sortWithinPartitions("key", "id")

    met = write_table(rows.mapInArrow(meet, "id bigint, mark bigint, first int, last int, key bigint, window bigint"), "substring-spans")
    crowd = met.where("key IS NOT NULL")
    least = crowd.groupBy("key", "window").agg(F.min("id").alias("least"))
    late = crowd.join(least, ["key", "window"]).where("id > least").select("id", "mark", "first", "last")
    spans = met.where("key IS NULL").select("id", "mark", "first", "last").unionByName(late)
    spans = spans.groupBy("id", "mark").agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("spans"))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = texts_of(batch.column(1)), batch.column(2)
            cuts = [cut(t, s.values.to_numpy()) if s.is_valid else (len(t.split()), 0, t) for t, s in zip(texts, spans, strict=True)]
            kept = pa.array([c[2] for c in cuts], pa.binary()).cast(pa.string())
            rest = [batch.column(3 + k) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()), kept, *rest], names=["id", "n_words", "n_removed", "kept_text", *carried])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    for name, column in zip(carried, carry, strict=True):
        schema = schema.add(name, docs.schema[column].dataType)
    joined = own.where("id IS NOT NULL").join(spans.hint("shuffle_hash"), ["id", "mark"], "left")
    joined = joined.unionByName(own.where("id IS NULL"), allowMissingColumns=True).select("id", "text", "spans", *carried)
    return joined.mapInArrow(trim, schema)
