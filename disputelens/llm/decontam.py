"""Benchmark decontamination as a prefix-filtered set join.

An item window is ``WINDOW`` consecutive words of an item (or the whole item
if it is shorter); a document word inside any occurrence of a window is hit.
A window's set is its word shingles. Containment needs *every* shingle, so the
necessary prefix is one shingle: the window's rarest over all documents.

1. Rarity: count the benchmark's shingles over all documents (counts are summed
   in the task, then shuffled). A window with a shingle that no document holds
   cannot occur and goes.
2. Documents emit only positions whose shingle may be a prefix (a fixed-size
   bitmap tells), with the words around them.
3. Equi join on the prefix shingle; length and position bounds (the window must
   fit into the document around that shingle); then the words are compared.
4. Hit words are the union of the occurrences' intervals, per document.

Defined cases: null or empty texts have no words and are clean; an item with a
null id marks words but is not listed or counted; repeated rows are each returned; repeated items count once
per item id. Extra columns are ignored. An empty benchmark leaves every
document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from disputelens.llm.common import (ALNUM, TASK_ROWS, BitFilter, Rolling, Words, bitmap_of, prepare, shingle_hash, store,
                                    text_chunks, valid_starts)

WINDOW = 10
#: Words of a shingle (all of a shorter window).
SHINGLE = 4
#: Bits of the filters over the benchmark's shingles.
FILTER_BITS = 1 << 25


def _windows(window: int, size: int):
    """item_id, and each window: its words, and the hash and offset of each shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for rows, texts in text_chunks(batches, "text"):
            ids, words_out, hashes_out = [], [], []
            words = Words(texts, ALNUM, lower=True, rolling=rolling)
            for item, first, n in zip(rows.column("item_id").to_pylist(), words.range[:-1].tolist(),
                                      words.count.tolist()):
                if not n:
                    continue
                span = range(first, first + n)
                text = [words.raw[words.starts[i]:words.ends[i]].decode() for i in span]
                k = min(size, n)
                shingles = shingle_hash(words.hash[first:first + n], k).view(np.int64)
                length = min(window, n)
                for at in range(n - length + 1):
                    ids.append(item)
                    words_out.append(text[at:at + length])
                    hashes_out.append(shingles[at:at + length - k + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=rows.column("item_id").type), pa.array(words_out, type=pa.list_(pa.string())),
                 pa.array(hashes_out, type=pa.list_(pa.int64()))], names=["item_id", "words", "shingles"])
    return run


def _count_shingles(wanted, sizes: list[int]):
    """(shingle, n) per chunk of documents, for shingles that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, passes = Rolling(), BitFilter(wanted.value)
        for _, texts in text_chunks(batches, "text"):
            words = Words(texts, ALNUM, lower=True, rolling=rolling)
            for size in sizes:
                h = shingle_hash(words.hash, size)[valid_starts(words, size)]
                found, n = np.unique(h[passes(h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])
    return run


_HITS = pa.list_(pa.struct([("pos", pa.int32()), ("shingle", pa.int64()), ("first", pa.int32()),
                            ("around", pa.list_(pa.string()))]))


def _candidates(wanted, sizes: list[int], reach: int):
    """Every document with its word count and the places whose shingle passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, passes = Rolling(), BitFilter(wanted.value)
        for rows, texts in text_chunks(batches, "text"):
            words = Words(texts, ALNUM, lower=True, rolling=rolling)
            hits: list[list] = [[] for _ in texts]
            doc_of = words.text_of()
            for size in sizes:
                at = valid_starts(words, size)
                h = shingle_hash(words.hash, size)[at]
                ok = passes(h)
                for i, shingle in zip(at[ok].tolist(), h[ok].view(np.int64).tolist()):
                    doc = doc_of[i]
                    first, last = int(words.range[doc]), int(words.range[doc + 1])
                    lo, hi = max(first, i - reach), min(last, i + size + reach)
                    hits[doc].append({"pos": i - first, "shingle": shingle, "first": lo - first, "around": [
                        words.raw[words.starts[j]:words.ends[j]].decode() for j in range(lo, hi)]})
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("id"), pa.array(words.count), pa.array(hits, type=_HITS)],
                names=["row", "id", "n_words", "hits"])
    return run


def benchmark_windows(bench: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words, shingles), and (win, item_id) pairs."""
    items = bench.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    all_windows = store(items.mapInArrow(_windows(window, size),
                                         f"item_id {kind}, words array<string>, shingles array<long>"), "windows")
    windows = store(all_windows.select("words", "shingles").distinct()
                    .withColumn("win", F.monotonically_increasing_id()), "windows", all_windows.count(), TASK_ROWS)
    return windows, all_windows.join(windows.select("words", "win"), "words").select("win", "item_id").distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated; and ``row``, the number of the input row."""
    spark = prepare(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                           F.col(text_col).cast("string").alias("text"))
    windows, members = benchmark_windows(bench, window, size)
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(size))).distinct().collect())
    low_bits = F.col("shingle").bitwiseAND(F.lit(FILTER_BITS - 1))

    shingles = windows.select("win", F.size("words").alias("length"), F.posexplode("shingles").alias("off", "shingle"))
    known = spark.sparkContext.broadcast(bitmap_of(shingles, low_bits, FILTER_BITS))
    counts = (numbered.select("text").mapInArrow(_count_shingles(known, sizes), "shingle long, n long")
              .groupBy("shingle").agg(F.sum("n").alias("n")))
    ranked = shingles.join(counts, "shingle", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off", "length")).alias("prefix"))
    prefixes = store(ranked.filter("prefix.n > 0").join(windows, "win").select(
        "win", "prefix.shingle", "prefix.off", "prefix.length", "words"), "prefixes", windows.count(), TASK_ROWS)

    wanted = spark.sparkContext.broadcast(bitmap_of(prefixes, low_bits, FILTER_BITS))
    kind = numbered.schema["id"].dataType.simpleString()
    places = store(numbered.mapInArrow(
        _candidates(wanted, sizes, window - 1),
        f"row long, id {kind}, n_words long, "
        "hits array<struct<pos:int,shingle:long,first:int,around:array<string>>>"), "places")

    start = F.col("pos") - F.col("off")
    found = (places.select("row", "n_words", F.inline("hits")).join(prefixes, "shingle")
             .filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
             .filter(F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("length"))
                     == F.col("words"))
             .select("row", "win", start.alias("start"), (start + F.col("length")).alias("stop")))
    found = store(found.distinct(), "found", places.count(), TASK_ROWS)

    before = F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop", "win")
                                .rowsBetween(Window.unboundedPreceding, -1))
    covered = found.withColumn("before", F.coalesce(before, F.lit(0)))
    n_hit = covered.groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"))
    items = (found.select("row", "win").distinct().join(members.filter(F.col("item_id").isNotNull()), "win")
             .select("row", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items")))
    out = places.select("row", "id", "n_words").join(n_hit, "row", "left").join(items, "row", "left")
    joined = F.coalesce(F.array_join("items", ","), F.lit(""))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "row")


def keep_clean(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) without a hit word. Equal texts fare alike, so texts go by their MD5."""
    name = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = decontaminate(docs.select(name.alias("name"), F.col(text_col).alias("text")), bench, "name", "text")
    # stored first: the planner then knows its size, and shuffles the texts only if it is large
    hit = store(found.filter("contaminated").select(F.unhex("name").alias("hit_name")).distinct(), "hit",
                docs.count(), TASK_ROWS)
    rows = docs.select(F.struct("*").alias("doc"), name.alias("name"))
    return rows.join(hit, F.unhex("name") == F.col("hit_name"), "left_anti").select("doc.*")
