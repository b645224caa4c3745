"""MinHash near-dedup: one-permutation hashing, banded buckets, star edges.

Method. A text's set is its distinct five-word shingles (64-bit hashes). One
permutation hash splits the hash space into ``BINS`` bins and keeps the least
value of each bin; empty bins take the value of a bin drawn by a hash of
(bin, attempt) until a filled one is met (optimal densification), so every bin
agrees for two sets with probability equal to their Jaccard similarity, and
``BANDS`` bands of ``ROWS`` bins make the buckets.

* Texts with equal sets are one class; all later work is on classes, so a
  group of copies is one row however large it is.
* Candidate edges are stars: every class of a bucket with the bucket's centre,
  so a bucket of m classes gives m-1 pairs, never m*m. The first centres are
  arbitrary. Later rounds look at the buckets that still hold several
  components and take the class with most confirmed links as centre, which
  finds the original of a family whose copies are too far from each other. The
  rounds end when one adds no link, after ``STARS`` at the latest.
* Stars don't test all pairs, so classes of buckets that then still hold several
  components are joined exactly, on their full sets and only between different
  components. Only shingles that two components hold can be common; a class
  emits the rarest of those until too few are left to reach the similarity
  (a prefix). The join's condition bounds the similarity from above by sizes, by
  places in the order, and by parity sketches: each set is folded to ``SKETCH``
  bits, the parities of its members per bit, so two sketches differ in no more bits
  than the sets have members that are not common. A pair that fails a bound cannot
  link and is never put out. A shingle of many classes is compared in blocks.
* Full sets are made once, for the classes that share a bucket, and stored.
* Each candidate is confirmed on the full sets; components follow by
  contracting the links, with tables in the shared folder between the steps. Nothing but
  a fixed-size bitmap and row counts reaches the driver.

With 32 bands of 4 rows a pair at similarity 0.75 shares no bucket with
probability 5e-6, at 0.8 with 5e-8.

Defined cases: a null or empty text has an empty set, links with nothing and is
its own component; repeated rows (same id, same text) are each returned and
each kept if the id is its component's smallest; a null id never is a
component's smallest, and a component of null ids only has a null id and keeps
nothing here (``keep_one`` keeps one row of it). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputelens.llm.common import (NON_SPACE, TASK_ROWS, TEXT_ROWS, U64, BitFilter, Rolling, Words, bitmap_of, discard,
                                    in_tasks, lists_of, mix, prepare, shingle_hash, store, text_chunks)

SHINGLE = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Least and most bits of the filter that keeps sets of classes without a shared bucket from being shuffled
#: (16 MB at most; the rows that pass it by chance are joined away).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Star rounds after the first; what they leave open is joined exactly.
STARS = 4
#: Bits of a set's parity sketch (a multiple of 64).
SKETCH = 2048
#: Classes of one shingle that a block of the exact join compares with another's.
BLOCK = 256
#: Densification draws: for each attempt, the bin that each empty bin looks at.
_DRAWS = np.random.Generator(np.random.PCG64(77)).integers(0, BINS, (1024, BINS))
_BAND_MULT = np.random.Generator(np.random.PCG64(78)).integers(1, 2**63, BINS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: list[bytes], rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets per text)."""
    words = Words(texts, NON_SPACE, lower=True, rolling=rolling)
    full = shingle_hash(words.hash, SHINGLE)
    sets = []
    for first, n in zip(words.range[:-1].tolist(), words.count.tolist()):
        if n >= SHINGLE:
            h = np.sort(full[first:first + n - SHINGLE + 1])
            sets.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif n:
            sets.append(shingle_hash(words.hash[first:first + n], n))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])


def set_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, whatever the order of its members."""
    out = []
    for salt in (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)):
        sums = np.concatenate([[U64(0)], np.cumsum(mix(values ^ salt), dtype=np.uint64)])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def one_permutation(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Densified signatures, one row of BINS values per non-empty set (empty sets: zeros)."""
    n = len(offsets) - 1
    sig = np.zeros((n, BINS), dtype=np.uint64)
    filled = np.zeros((n, BINS), dtype=bool)
    row = np.repeat(np.arange(n), np.diff(offsets))
    bins = (values >> U64(57)).astype(np.int64)  # sorted values: the first of a bin is its least
    slot = row * BINS + bins
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, dtype=bool)
    sig.reshape(-1)[slot[first]] = values[first]
    filled.reshape(-1)[slot[first]] = True
    r, c = np.nonzero(~filled & (np.diff(offsets) > 0)[:, None])
    for draw in _DRAWS:
        if not len(r):
            break
        source = draw[c]
        ok = filled[r, source]
        sig[r[ok], c[ok]] = sig[r[ok], source[ok]]
        r, c = r[~ok], c[~ok]
    if len(r):  # all draws missed: the next filled bin to the right
        source = (c + 1) % BINS
        while not (ok := filled[r, source]).all():
            source = np.where(ok, source, (source + 1) % BINS)
        sig[r, c] = sig[r, source]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit bucket keys per row; the band's number is part of the key."""
    parts = (mix(sig) * _BAND_MULT).reshape(len(sig), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return mix(parts + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """SKETCH bits as longs: for each bit, whether an odd number of the members falls on it."""
    odd = np.bincount((members % U64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for rows, texts in text_chunks(batches, "text"):
        values, offsets = shingle_sets(texts, rolling)
        k1, k2 = set_keys(values, offsets)
        sizes = np.diff(offsets)
        bands = band_keys(one_permutation(values, offsets))[sizes > 0]
        ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
        columns = [rows.column("id"), rows.column("id_hash"), pa.array(sizes), pa.array(k1), pa.array(k2),
                   lists_of(bands.reshape(-1), ends)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "id_hash", "n_shingles", "k1", "k2", "bands"])


def _sets(wanted):
    """Emit the set of each row whose (set key, id) is in the bitmap ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        passes = BitFilter(wanted.value)
        for rows, texts in text_chunks(batches, "text"):
            values, offsets = shingle_sets(texts, rolling)
            k1, k2 = set_keys(values, offsets)
            id_hash = np.asarray(rows.column("id_hash").to_numpy(zero_copy_only=False), dtype=np.int64)
            hit = passes(k1 ^ id_hash) & (np.diff(offsets) > 0)
            if not hit.any():
                continue
            at = np.flatnonzero(hit)
            sets = [values[offsets[i]:offsets[i + 1]] for i in at]
            members = np.concatenate(sets).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[at])])
            words = np.concatenate([parity_sketch(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[at]), pa.array(k2[at]), pa.array(id_hash[at]), lists_of(members, ends),
                 lists_of(words, np.arange(len(at) + 1) * (SKETCH // 64))],
                names=["k1", "k2", "id_hash", "members", "sketch"])
    return run


def _bitmap(keys: DataFrame) -> bytes:
    """Bits set at (k1 xor id_hash) of each row, 8 to 16 per row within LEAST_BITS and MOST_BITS."""
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys.count()).bit_length()))
    pos = F.col("k1").bitwiseXOR(F.col("id_hash")).bitwiseAND(F.lit(n_bits - 1))
    return bitmap_of(keys, pos, n_bits)


_SIG_SCHEMA = "id {id}, id_hash long, n_shingles long, k1 long, k2 long, bands array<long>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "id_hash", F.xxhash64("id"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, id_hash, n_shingles, k1 and k2 (the set's 128-bit key), bands (empty for an empty set)."""
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(_signatures, _SIG_SCHEMA.format(id=kind))


def _classes(sig: DataFrame) -> DataFrame:
    """One row per distinct non-empty set, numbered by ``cid``; ``rep`` is its smallest id."""
    same = sig.filter("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.min_by("id_hash", "id").alias("by_id"), F.min("id_hash").alias("any_id"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    return store(same.select("k1", "k2", "rep", F.coalesce("by_id", "any_id").alias("id_hash"), "n", "bands",
                             F.monotonically_increasing_id().alias("cid")), "classes", sig.count(), TASK_ROWS)


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, cid, n) of the buckets that hold two classes or more."""
    rows = classes.select(F.explode("bands").alias("bucket"), "cid", "n")
    several = rows.groupBy("bucket").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi")
    return store(rows.join(several.select("bucket"), "bucket", "left_semi"), "buckets", classes.count(), TASK_ROWS)


def _star(buckets: DataFrame, rank: list[str], when: Column | None = None) -> DataFrame:
    """Distinct (a, b), a < b: each class of a bucket with the one that comes last by ``rank``."""
    rest = [c for c in buckets.columns if c not in ("bucket", *rank, "cid")]
    centre = buckets.groupBy("bucket").agg(F.max(F.struct(*rank, "cid", *rest)).alias("centre"))
    pairs = buckets.join(centre, "bucket").filter(
        (F.col("cid") != F.col("centre.cid")) & (F.lit(True) if when is None else when)
        # sizes alone rule out a similarity of PERCENT
        & (F.least("n", "centre.n") * 100 >= F.greatest("n", "centre.n") * PERCENT))
    return pairs.select(F.least("cid", "centre.cid").alias("a"), F.greatest("cid", "centre.cid").alias("b")).distinct()


def _members(keyed: DataFrame, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """(cid, members, sketch): the full sets of the classes in ``cids``, stored."""
    wanted = store(classes.join(cids, "cid", "left_semi").select("k1", "k2", "id_hash", "cid"), "wanted",
                   classes.count(), TASK_ROWS)
    bits = keyed.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    found = keyed.mapInArrow(_sets(bits), "k1 long, k2 long, id_hash long, members array<long>, sketch array<long>")
    # copies of a representative (same id, same text) give equal sets: any of them will do
    sets = store(found.join(wanted, ["k1", "k2", "id_hash"]).dropDuplicates(["cid"]).select("cid", "members", "sketch"),
                 "sets", wanted.count(), TEXT_ROWS)
    discard(wanted)
    return sets


def _linked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The ``pairs`` (a stored table) whose full sets reach the similarity, stored."""
    both = (pairs.join(members.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a")
            .join(members.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b"))
    inter = F.size(F.array_intersect("ma", "mb"))
    union = F.size("ma") + F.size("mb") - inter
    return store(both.filter(inter * 100 >= union * PERCENT).select("a", "b"), "links", pairs.count(), TASK_ROWS)


def _prefixes(open_classes: DataFrame, members: DataFrame) -> DataFrame:
    """(shingle, cid, root, n, rest, sketch): the shingles of which a link to another component must hold the first.

    Shingles that two components hold are ordered from rare to common. ``rest``
    counts those of the class from this one on, itself included: a link whose
    first common shingle this is has no larger intersection.
    """
    rows = open_classes.join(members.select("cid", "members"), "cid").select("cid", "root", F.explode("members").alias("shingle"))
    across = (rows.groupBy("shingle").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
              .filter("lo < hi").select("shingle", "m"))
    held = (rows.select("cid", "shingle").join(across, "shingle").groupBy("cid")
            .agg(F.sort_array(F.collect_list(F.struct("m", "shingle"))).alias("held")))
    rest = F.size("held") - F.col("at")
    few = held.join(open_classes, "cid").filter(F.size("held") * 100 >= F.col("n") * PERCENT)
    return store(few.join(members.select("cid", "sketch"), "cid")
                 .select("cid", "root", "n", "held", "sketch", F.posexplode("held").alias("at", "s"))
                 .filter(rest * 100 >= F.col("n") * PERCENT)
                 .select("s.shingle", "cid", "root", "n", rest.alias("rest"), "sketch"),
                 "prefixes", open_classes.count(), TEXT_ROWS)


def _prefix_pairs(prefixes: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of different components that may link, stored."""
    several = (prefixes.groupBy("shingle").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
               .filter("lo < hi").select("shingle", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    rows = prefixes.join(several, "shingle").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    one = rows.select("shingle", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"),
                      *[F.col(c).alias(f"{c}1") for c in ("cid", "root", "n", "rest", "sketch")])
    two = rows.select("shingle", F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"),
                      *[F.col(c).alias(f"{c}2") for c in ("cid", "root", "n", "rest", "sketch")])
    both = F.col("n1") + F.col("n2")
    differ = sum((F.bit_count(F.get("sketch1", F.lit(i)).bitwiseXOR(F.get("sketch2", F.lit(i)))) for i in range(SKETCH // 64)),
                 F.lit(0))
    pairs = one.join(two, ["shingle", "x", "y"]).filter(
        (F.col("root1") != F.col("root2")) & ((F.col("x") < F.col("y")) | (F.col("cid1") < F.col("cid2")))
        & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * PERCENT)
        & (F.least("rest1", "rest2") * (100 + PERCENT) >= both * PERCENT)
        # the members that are not common are at least as many as the bits that differ
        & ((both - differ) * (100 + PERCENT) >= both * (2 * PERCENT)))
    return store(pairs.select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b")).distinct(),
                 "pairs", prefixes.count(), TASK_ROWS)


def _links_left(members: DataFrame, buckets: DataFrame, roots: DataFrame) -> DataFrame | None:
    """All links between the components of ``roots`` among classes that share a bucket; None without such classes."""
    rows = buckets.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "bucket", "cid", "n", F.coalesce("root", "cid").alias("root"))
    # the first star settled the buckets of two classes
    left = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter(
        "lo < hi and m > 2")
    open_classes = store(rows.join(left.select("bucket"), "bucket", "left_semi").select("cid", "n", "root").distinct(),
                         "open", members.count(), TASK_ROWS)
    if open_classes.isEmpty():
        return None
    prefixes = _prefixes(open_classes, members)
    pairs = _prefix_pairs(prefixes)
    links = _linked(pairs, members)
    discard(open_classes, prefixes, pairs)
    return links


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node that it reaches.

    Each step sends a node to the least of itself and its neighbours, follows these
    pointers to their end by doubling, and keeps the edges that still join different
    nodes. Ends are nodes less than all their neighbours, at most half of the nodes
    that have edges, so the steps are logarithmic, and so are the doublings of a step.
    """
    roots, n = None, edges.count()
    most = n
    while True:
        near = (edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                              F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
                .groupBy("node").agg(F.min("other").alias("other"))
                .select("node", F.least("node", "other").alias("root")))
        near = _to_the_end(store(near, "near", 2 * n), 2 * n)
        left = (edges.join(near.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                .join(near.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
                .filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        edges = store(left, "edges", n)
        if roots is None:
            roots = near
        else:
            before, roots = roots, store(follow(roots, near), "roots", 2 * most)
            discard(before, near)
        n = edges.count()
        if not n:
            return roots


def _to_the_end(near: DataFrame, most: int) -> DataFrame:
    """Pointers (node, root) replaced by the ends of their paths; each pass doubles the way."""
    while True:
        far = near.select(F.col("node").alias("root"), F.col("root").alias("far"))
        passed = store(near.select("node", "root").join(far, "root").select(
            "node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "near", most)
        if passed.filter("moved").isEmpty():
            discard(passed)
            return near
        discard(near)
        near = passed.select("node", "root")
        near.stored_at = passed.stored_at


def follow(roots: DataFrame, later: DataFrame) -> DataFrame:
    """``roots`` (node, root) with each root replaced by its own root in ``later``."""
    far = later.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return roots.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root) with the components that the links ``more`` connect as one."""
    of = roots.select(F.col("node"), F.col("root"))
    ends = (more.join(of.toDF("a", "ra"), "a", "left").join(of.toDF("b", "rb"), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct())
    n = more.count()
    merged = contract(store(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                            "edges", n))
    return store(follow(roots, merged).union(merged.join(roots.select("node"), "node", "left_anti")), "roots",
                 roots.count() + 2 * n)


def linked_components(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) of the classes with a confirmed link."""
    keyed = _keyed(docs, id_col, text_col)
    buckets = _shared_buckets(classes)
    members = _members(keyed, classes, buckets.select("cid").distinct())
    n = members.count()
    tried = store(_star(buckets, []), "pairs", n, TASK_ROWS)
    links = _linked(tried, members)
    roots = store(contract(links), "roots", 2 * links.count())
    for _ in range(STARS):
        degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("degree"))
        known = roots.withColumnRenamed("node", "cid").join(degree, "cid", "left")
        rows = buckets.join(known, "cid", "left").select(
            "bucket", "cid", "n", F.coalesce("root", "cid").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
        split = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        open_ = store(rows.join(split.select("bucket"), "bucket", "left_semi"), "buckets", n, TASK_ROWS)
        discard(buckets)
        new = store(_star(open_, ["degree"], F.col("root") != F.col("centre.root")).join(tried, ["a", "b"], "left_anti"),
                    "pairs", n, TASK_ROWS)
        buckets = open_.select("bucket", "cid", "n")
        buckets.stored_at = open_.stored_at
        more = None if new.isEmpty() else _linked(new, members)
        if more is None or more.isEmpty():
            break
        tried, links = tried.union(new), links.union(more)
        roots = _joined(roots, more)
    more = _links_left(members, buckets, roots)
    found = roots if more is None or more.isEmpty() else _joined(roots, more)
    discard(members)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of ``docs``.

    Runs its rounds when called; their tables lie in the shared folder.
    """
    prepare(docs.sparkSession)
    sig = store(signatures(docs, id_col, text_col), "sig")
    classes = _classes(sig)
    roots = linked_components(docs, classes, id_col, text_col).withColumnRenamed("node", "cid")
    named = classes.join(roots, "cid", "left").select("k1", "k2", "rep", F.coalesce("root", "cid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_set = store(named.join(least, "comp").select("k1", "k2", "component_id"), "components", classes.count(), TASK_ROWS)
    discard(classes)
    # empty sets share a key, but need no component
    full = sig.filter("n_shingles > 0").select("id", "n_shingles", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    out = full.select("id", "n_shingles", "component_id").union(
        sig.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one per component.

    The row with the component's smallest id stays; of repeated rows with that
    id, or when all ids are null, the first stored one. Rows with an empty set
    all stay.
    """
    prepare(docs.sparkSession)
    numbered = store(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    of_doc = F.col(f"doc.`{id_col}`")
    # ordered by id with nulls last, then by row: every row has an id of its own
    rank = F.struct(of_doc.isNull().alias("unnamed"), of_doc.alias("id"), F.col("row"))
    found = near_duplicates(numbered.select(rank.alias("id"), F.col(f"doc.`{text_col}`").alias("text")), "id", "text")
    kept = found.filter("kept").select(F.col("id.row").alias("row"))
    return in_tasks(numbered.join(kept, "row", "left_semi").select("doc.*"), numbered.count(), TEXT_ROWS)
