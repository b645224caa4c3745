"""Exact substring dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else
too. A transform over the whole corpus would be one sort of all bytes, so the
corpus is first cut into strings that can hold a repeat.

1. Anchors. Each window of LENGTH bytes has one anchor: the leftmost of its
   k-grams (``CORE`` bytes) with the least hash. Equal windows have equal anchors
   at the same place, so repeats can only lie among windows of the same anchor
   k-gram, and each window belongs to exactly one anchor. Neighbouring windows
   of one anchor are a fragment. Only (k-gram key, fragment key) pairs are counted
   over all documents; k-grams met once are done.
2. A k-gram whose fragments are all equal is one repeated text: pre-aggregation
   settles it. The others' fragments, once each with the number of their places,
   are dealt by k-gram. All windows of an anchor hold its k-gram, so it is
   written as one symbol; a window is then ``DEPTH`` symbols.
3. A task joins the fragments of many k-grams to a text, sorts its suffixes and
   takes the Burrows-Wheeler transform. Intervals of suffixes with a common
   prefix grow by breadth-first backward extension: the boundaries with common
   prefix l, extended by each symbol before them, give the boundaries with l + 1. At
   l = DEPTH the expansion stops; suffixes with no boundary between them agree on
   a whole window.
4. Repeated windows go back to their places, their union per text is removed.

k-grams with more than ``GROUP`` different fragments would not fit into one text;
their windows are compared by 64-bit hashes in a shuffle instead (each window is
its own key, so no task gets the group).

Keys are 64-bit hashes of at least CORE bytes; a clash could only matter if the
symbols around it agree as well. Texts are named by MD5.

Defined cases: a null text is empty; texts under LENGTH bytes are kept whole;
repeated rows are each returned, and their texts (if long enough) are repeats of
each other; null ids are carried as null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.llm.common import (TEXT_ROWS, U64, BitFilter, Rolling, bitmap_of, discard, in_tasks, prepare, store,
                                    text_chunks)

LENGTH = 200
CORE = 100
#: k-grams of a window, which is also its length when the k-gram is one symbol.
DEPTH = LENGTH - CORE + 1
#: Symbols of one transform, and different fragments of one k-gram in it at most.
BLOCK = 1 << 20
GROUP = 5000
FILTER_BITS = 1 << 26
#: Bits of a position within an array; longer texts are taken in overlapping pieces, each an array of its own.
_POS_BITS = 26
_PIECE = 1 << 25


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    m, span = v, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


class Fragments:
    """The fragments of several texts, in order: text, at (first window), n (windows), left (the anchor's place), keys."""

    def __init__(self, texts: list[bytes], rolling: Rolling):
        self.texts = texts
        parts, group, size = [], [], 0
        for i, t in enumerate(texts):
            for o in range(0, len(t) - LENGTH + 1, _PIECE):
                piece = t[o:o + _PIECE + LENGTH - 1] if len(t) > _PIECE else t
                if group and size + len(piece) > _PIECE + LENGTH - 1:  # positions start at 0 again
                    parts.append(self._part(group, rolling))
                    group, size = [], 0
                group.append((i, o, piece))
                size += len(piece)
        if group:
            parts.append(self._part(group, rolling))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * 6
        self.text, self.at, self.n, self.left, self.core_key, self.key = columns

    @staticmethod
    def _part(pieces: list[tuple[int, int, bytes]], rolling: Rolling) -> tuple[np.ndarray, ...]:
        """The columns of the fragments of pieces (text, offset, bytes) that one array holds."""
        data = np.frombuffer(b"".join([p[2] for p in pieces]), dtype=np.uint8)
        size = np.fromiter((len(p[2]) for p in pieces), dtype=np.int64, count=len(pieces))
        begin = np.cumsum(size) - size
        prefix = rolling.prefix(data)
        grams = len(data) - CORE + 1
        order = (prefix[CORE:] - prefix[:grams]) * rolling.down[:grams] * U64(0xD6E8FEB86659FD93)
        low = U64((1 << _POS_BITS) - 1)
        least = _sliding_least((order & ~low) | np.arange(grams, dtype=np.uint64), DEPTH)
        valid = np.ones(len(least), dtype=bool)
        for b in begin[1:].tolist():  # windows that would cross into the next piece
            valid[b - LENGTH + 1:b] = False
        start = np.flatnonzero(valid)
        anchor = (least[start] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.concatenate([first, [len(start)]]))
        lo, anchor = start[first], anchor[first]
        piece = np.searchsorted(begin, lo, side="right") - 1
        text = np.array([p[0] for p in pieces], dtype=np.int64)[piece]
        at = lo - begin[piece] + np.array([p[1] for p in pieces], dtype=np.int64)[piece]
        core_key = rolling.spans(prefix, anchor, anchor + CORE).view(np.int64)
        key = rolling.spans(prefix, lo, lo + n + LENGTH - 1).view(np.int64)
        return text, at, n, anchor - lo, core_key, key

    def flanks(self, i: int) -> bytes:
        """The fragment's bytes but for the k-gram."""
        t, lo, a = self.texts[self.text[i]], int(self.at[i]), int(self.at[i] + self.left[i])
        return t[lo:a] + t[a + CORE:lo + int(self.n[i]) + LENGTH - 1]


def _count_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: k-gram key, places, least and largest fragment key."""
    rolling = Rolling()
    for _, texts in text_chunks(batches, "text"):
        f = Fragments(texts, rolling)
        order = np.lexsort((f.key, f.core_key))
        core, key = f.core_key[order], f.key[order]
        first = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]])) if len(core) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(core)]]) - 1 if len(core) else first
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (core[first], last - first + 1, key[first], key[last])],
                                         names=["core", "n", "lo", "hi"])


def _places(repeated, mixed):
    """Every fragment whose k-gram may be repeated; its flanks too if its k-gram may have several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        keep, several = BitFilter(repeated.value), BitFilter(mixed.value)
        for rows, texts in text_chunks(batches, "text"):
            f = Fragments(texts, rolling)
            if not len(f.n):
                continue
            i = np.flatnonzero(keep(f.core_key))
            flanks = [f.flanks(j) if s else None for j, s in zip(i.tolist(), several(f.core_key[i]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("name").take(pa.array(f.text[i])), *map(pa.array, (f.core_key[i], f.key[i], f.at[i], f.n[i])),
                 pa.array(f.left[i]), pa.array(flanks, type=pa.binary())],
                names=["name", "core", "key", "at", "n", "left", "flanks"])
    return run


# --- the transform ---------------------------------------------------------------

def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the place of each, by prefix doubling of the parts not yet told apart."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64) + U64(1), np.zeros(4, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    width = max(int(symbols.max()).bit_length() + 1, 8)
    depth = max(1, min(4, 64 // width))
    for j in range(depth):
        key = (key << U64(width)) | padded[j:n + j]
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    group = np.repeat(first, size)
    place = np.empty(n, dtype=np.int64)
    place[order] = group
    open_at = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_at):
        suffix = order[open_at]
        ahead = suffix + depth
        next_place = np.where(ahead < n, place[np.minimum(ahead, n - 1)], -1)
        both = group[open_at] * (n + 1) + next_place + 1
        by = np.argsort(both)
        both, suffix = both[by], suffix[by]
        order[open_at] = suffix
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        size = np.diff(np.concatenate([first, [len(both)]]))
        group[open_at] = np.repeat(open_at[first], size)
        place[suffix] = group[open_at]
        open_at = open_at[np.repeat(size > 1, size)]
        depth *= 2
    return order, place


def expand_intervals(symbols: np.ndarray, order: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """For each sorted suffix, whether a boundary parts it from the one before it: a common prefix under ``depth``.

    Two neighbours that start with the same symbol c stand, without it, at p < q;
    in the transform those are consecutive places of c. Their common prefix is
    one more than the least between p and q, so a boundary found at l in (p, q]
    extends backward by c to a boundary at l + 1. Boundaries are found in the
    order of l, all of one l together, until l reaches ``depth``.
    """
    n = len(symbols)
    boundary = np.ones(n, dtype=bool)
    head = symbols[order]
    open_at = np.flatnonzero(head[1:] == head[:-1]) + 1
    boundary[open_at] = False
    found = np.flatnonzero(boundary)
    after = order[np.concatenate([open_at - 1, open_at])] + 1
    after = np.where(after < n, place[np.minimum(after, n - 1)], -1)  # the empty suffix comes first
    p, q = after[:len(open_at)], after[len(open_at):]
    for _ in range(1, depth):
        if not len(open_at) or not len(found):
            break
        if len(open_at) * 16 > n:
            seen = np.zeros(n + 1, dtype=np.int32)
            seen[found + 1] = 1
            np.cumsum(seen, out=seen)
            hit = seen[q + 1] > seen[p + 1]
        else:
            at = np.searchsorted(found, p, side="right")
            hit = (at < len(found)) & (found[np.minimum(at, len(found) - 1)] <= q)
        found = open_at[hit]
        boundary[found] = True
        open_at, p, q = open_at[~hit], p[~hit], q[~hit]
    return boundary


def repeated_windows(symbols: np.ndarray, windows: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which of the ``windows`` (start symbols) agree on ``depth`` symbols with others, or stand for several."""
    order, place = suffix_order(symbols)
    boundary = expand_intervals(symbols, order, place, depth)
    interval = np.empty(len(symbols), dtype=np.int64)
    interval[order] = np.cumsum(boundary) - 1
    total = np.bincount(interval[windows], weights=weight, minlength=int(boundary.sum()))
    return total[interval[windows]] >= 2


def _block_runs(core: list[int], key: list[int], n: np.ndarray, left: np.ndarray, weight: np.ndarray,
                flanks: list[bytes]) -> pa.RecordBatch:
    """Runs of repeated windows of the fragments of whole k-gram groups."""
    _, symbol = np.unique(np.array(core), return_inverse=True)
    size = n + DEPTH - 1
    begin = np.cumsum(size) - size
    symbols = np.empty(int(size.sum()), dtype=np.int64)
    is_core = np.zeros(len(symbols), dtype=bool)
    is_core[begin + left] = True
    symbols[is_core] = 256 + symbol
    symbols[~is_core] = np.frombuffer(b"".join(flanks), dtype=np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    hit = repeated_windows(symbols, begin[of] + inner, weight[of], DEPTH)
    same = (of[1:] == of[:-1]) & hit[:-1]
    opens = np.flatnonzero(hit & ~np.concatenate([[False], same]))
    closes = np.flatnonzero(hit & ~np.concatenate([same & hit[1:], [False]]))
    owner = of[opens]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(core)[owner]), pa.array(np.array(key)[owner]), pa.array(inner[opens]),
         pa.array(inner[closes] + 1)], names=["core", "key", "first", "last"])


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by k-gram in, runs of repeated windows out, a block of whole groups at a time."""
    held: list[tuple] = []
    size, last = 0, None

    def done() -> pa.RecordBatch:
        core, key, n, left, weight, flanks = map(list, zip(*held))
        held.clear()
        return _block_runs(core, key, np.array(n), np.array(left), np.array(weight, dtype=np.float64), flanks)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("core", "key", "n", "left", "weight", "flanks")]
        for row in zip(*columns):
            if size >= BLOCK and row[0] != last:
                yield done()
                size = 0
            held.append(row)
            size += row[2] + DEPTH - 1
            last = row[0]
    if held:
        yield done()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """core, key, weight, and for each window its number and hash (for groups beyond one transform)."""
    for batch in batches:
        out = []
        for core, key, n, left, weight, flanks in zip(
                *(batch.column(c).to_pylist() for c in ("core", "key", "n", "left", "weight", "flanks"))):
            for i in range(n):  # DEPTH - 1 flank bytes, and where the k-gram stands among them
                text = flanks[i:i + DEPTH - 1] + (left - i).to_bytes(4, "big")
                h = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)
                out.append((core, key, weight, i, h))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (zip(*out) if out else [()] * 5)],
                                         names=["core", "key", "weight", "i", "hash"])


def _runs(fragments: DataFrame, group: int) -> DataFrame:
    """(core, key, first, last): runs of repeated windows of the distinct fragments."""
    large = fragments.groupBy("core").agg(F.count("*").alias("m")).filter(F.col("m") > group).select("core")
    columns = "core", "key", "n", "left", "weight", "flanks"
    small = fragments.join(large, "core", "left_anti").select(*columns)
    schema = "core long, key long, first long, last long"
    symbols = fragments.select(F.sum(F.col("n") + (DEPTH - 1))).first()[0] or 0
    parts = 1 + symbols // (2 * BLOCK)
    by_transform = small.repartition(parts, "core").sortWithinPartitions("core", "key").mapInArrow(_transform, schema)
    hashed = fragments.join(large, "core", "left_semi").select(*columns).mapInArrow(
        _window_hashes, "core long, key long, weight long, i long, hash long")
    again = hashed.groupBy("core", "hash").agg(F.sum("weight").alias("w")).filter("w >= 2").select("core", "hash")
    by_hash = hashed.join(again, ["core", "hash"]).select("core", "key", F.col("i").alias("first"),
                                                          (F.col("i") + 1).alias("last"))
    return by_transform.union(by_hash)


def repeated_spans(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(name, spans): byte ranges to remove, unmerged; ``texts``: name (MD5), text."""
    spark = prepare(texts.sparkSession)
    low_bits = F.col("core").bitwiseAND(F.lit(FILTER_BITS - 1))
    n = texts.count()
    cores = store(texts.select("text").mapInArrow(_count_cores, "core long, n long, lo long, hi long").groupBy("core")
                  .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n >= 2")
                  .select("core", (F.col("lo") == F.col("hi")).alias("alike")), "cores", n, TEXT_ROWS)
    repeated = spark.sparkContext.broadcast(bitmap_of(cores, low_bits, FILTER_BITS))
    mixed = spark.sparkContext.broadcast(bitmap_of(cores.filter("not alike"), low_bits, FILTER_BITS))
    places = store(texts.mapInArrow(
        _places(repeated, mixed),
        "name binary, core long, key long, at long, n long, left long, flanks binary"), "places")
    alike = places.select("name", "core", "at", "n").join(cores.filter("alike").select("core"), "core", "left_semi")
    several = cores.filter("not alike").select("core")
    # copies are added up by (core, key) first: a k-gram with very many places is a few rows at the join
    fragments = (places.filter(F.col("flanks").isNotNull()).groupBy("core", "key")
                 .agg(F.first("n").alias("n"), F.first("left").alias("left"), F.count("*").alias("weight"),
                      F.first("flanks").alias("flanks")).join(several, "core", "left_semi"))
    fragments = store(fragments, "fragments", n, TEXT_ROWS)
    runs = store(_runs(fragments, group), "runs", n, TEXT_ROWS)
    back = places.select("name", "core", "key", "at").join(runs, ["core", "key"])
    spans = alike.select("name", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (LENGTH - 1)).alias("hi")).union(
        back.select("name", F.col("at") + F.col("first"), F.col("at") + F.col("last") + (LENGTH - 1)))
    found = store(spans.distinct().groupBy("name").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans", n, TEXT_ROWS)
    discard(cores, places, fragments, runs)
    return found


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Union of ranges as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in runs]]
    return b"".join([text[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(text)])])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_chunks(batches, "text"):
        runs = [merged_spans(s) for s in rows.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), pa.array([len(t) for t in texts]),
             pa.array([sum(b - a for a, b in r) for r in runs], type=pa.int64()),
             pa.array([len(r) for r in runs], type=pa.int64()),
             pa.array([hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(texts, runs)])],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` (null: empty) and its ``name``; the caller's own columns are under other names."""
    filled = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return filled.withColumn("name", F.unhex(F.md5("text")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of ``docs``."""
    rows = _named(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    spans = repeated_spans(rows.select("name", "text"), group)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.join(spans, "name", "left").select("id", "text", "spans").mapInArrow(
        _digests, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def kept_texts(docs: DataFrame, text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``docs`` with its text cut: all columns stay. Bytes of a character cut in two are dropped."""
    inner = docs.select(F.struct("*").alias("doc"), F.col(f"{text_col}").cast("string").alias("text"))
    rows = _named(inner)
    spans = repeated_spans(rows.select("name", "text"), group)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            runs = [merged_spans(s) for s in part.column("spans").to_pylist()]
            kept = [kept_bytes(t, r).decode("utf-8", "ignore") for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(kept, type=pa.string())], names=["doc", "kept"])

    schema = rows.select("doc").schema.add("kept", "string")
    done = in_tasks(rows.join(spans, "name", "left").select("doc", "text", "spans").mapInArrow(cut, schema),
                    docs.count(), TEXT_ROWS)
    # a null text stays null
    kept = F.when(F.col(f"doc.{text_col}").isNotNull(), F.col("kept"))
    return done.select(*[kept.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
