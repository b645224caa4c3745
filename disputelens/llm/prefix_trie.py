"""Conversation prefix trie by depth-band rollup.

Conversations that begin with the same turns share nodes; a node is a distinct
sequence of first turns. What each node's subtree holds (leaves, tokens saved by
storing a prefix once) is summed without walking the trie level by level:

* A node is named by 128 bits: the XOR of hashes of (turn's SHA-256, place) over
  its turns. XOR is associative, so the names of a long conversation's prefixes
  come from segments of 1024 turns and the segments' totals, never from one task
  that holds the conversation.
* Depths are cut into bands of ``BAND``. Each node's value is exploded to its
  ancestors within its band only, at most ``BAND`` rows, and summed.
* The top nodes of the bands form a smaller trie, ``BAND`` times less deep, whose
  values are the band sums. It is rolled up by the same step, which gives complete
  totals of the band tops; those are handed to the node above each band top and to
  that node's ancestors within its band.

So a trie of depth D takes log(D) / log(BAND) rounds and no row is exploded to more
than ``BAND`` ancestors in a round. Counts are pre-aggregated before each shuffle;
the join with the parents, where a parent may have a third of all nodes as
children, is an ordinary sort-merge join that adaptive execution splits.

Rows without conv_id belong to no conversation and are left out; a null turn
number comes first; null role or text is empty; rows of one turn number are taken by
the SHA-256 of role and text, so repeated rows are turns of their own. An empty
table gives no node. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputelens.llm.common import prepare, store
from disputelens.llm.ordered import digest_in_order, in_ranges, runs

#: Depths of a band: the most ancestors that a node is exploded to.
BAND = 8
#: Turns of one segment when prefix names are made (a multiple of BAND).
SEGMENT = 1024
#: Members whose ids one row holds on the way to a node's digest.
IDS = 4096
KEY = ["k1", "k2"]
SUMS = ["n_leaves", "saved_tokens"]


# --- turns in order -------------------------------------------------------------

def turn_digest(role: str = "role", text: str = "text") -> Column:
    """SHA-256 (hex) of a turn; null is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def _in_parts(conversations: DataFrame) -> DataFrame:
    """(part, conv_id, turn, digest, words), stored; texts stay behind."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), turn_digest().alias("digest"),
        words.cast("long").alias("words"))
    return store(in_ranges(rows, "conv_id", "turn", "digest"), "turns")


def _lengths(parts: DataFrame) -> DataFrame:
    """conv_id, part, n, before: rows of each part of a conversation and of its earlier parts."""
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _placed(parts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each turn with ``at``, its place in the conversation from 1, and the columns of ``lengths``."""
    local = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return (parts.withColumn("i", F.row_number().over(local)).join(lengths, ["conv_id", "part"])
            .withColumn("at", F.col("before") + F.col("i")))


def share_heads(conversations: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, depth, digest, words), and (conv_id, length), both stored.

    Conversation c takes its first crc32(c) % ``most`` turns from conversation
    c - c % ``group``, as many as there are, then its own turns after as many.
    """
    parts = _in_parts(conversations)
    lengths = store(_lengths(parts), "lengths")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = lengths.groupBy("conv_id").agg(F.sum("n").alias("n")).select(
        "conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("donor"))
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    members = store(convs.join(donors, "donor", "left").select(
        "conv_id", "h", "donor", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "members")
    own = (_placed(parts, lengths.join(members.select("conv_id", "h", "taken", "length"), "conv_id"))
           .filter("at > h").withColumn("depth", F.col("at") - F.col("h") + F.col("taken")))
    heads = (_placed(parts.filter(F.col("conv_id") % group == 0), lengths).filter(F.col("at") < most)
             .select(F.col("conv_id").alias("donor"), F.col("at").alias("depth"), "digest", "words"))
    borrowed = heads.join(members, "donor").filter("depth <= taken")
    columns = ["conv_id", "depth", "digest", "words", (F.col("depth") == F.col("length")).alias("last")]
    return store(own.select(*columns).union(borrowed.select(*columns)), "rebuilt"), members.select("conv_id", "length")


# --- nodes ------------------------------------------------------------------------

def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its prefix's name (k1, k2), its parent's (u1, u2), and the names above it in its band; stored."""
    step = [F.xxhash64(F.lit(salt), "digest", "depth") for salt in (1, 2)]
    rows = turns.select("conv_id", "depth", "words", "last", *[s.alias(f"s{j}") for j, s in enumerate(step, 1)],
                        F.floor((F.col("depth") - 1) / SEGMENT).alias("segment"))
    upto = Window.partitionBy("conv_id", "segment").orderBy("depth")
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "segment").agg(F.bit_xor("s1").alias("t1"), F.bit_xor("s2").alias("t2")).select(
        "conv_id", "segment", *[F.coalesce(F.bit_xor(f"t{j}").over(earlier), F.lit(0)).alias(f"e{j}") for j in (1, 2)])
    named = rows.withColumns({f"x{j}": F.bit_xor(f"s{j}").over(upto) for j in (1, 2)}).join(totals, ["conv_id", "segment"])
    named = named.withColumns({f"k{j}": F.col(f"x{j}").bitwiseXOR(F.col(f"e{j}")) for j in (1, 2)})
    in_band = ((F.col("depth") - 1) % BAND + 1).cast("int")
    above = F.collect_list(F.struct(*KEY)).over(upto.rowsBetween(1 - BAND, Window.currentRow))
    return store(named.withColumn("above", above).select(
        "conv_id", "depth", "words", "last", *KEY, *[F.col(f"k{j}").bitwiseXOR(F.col(f"s{j}")).alias(f"u{j}") for j in (1, 2)],
        F.slice("above", -in_band, in_band).alias("path")), "prefixes")


def _nodes(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node, the root (0, 0) included, stored."""
    below = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"),
        F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.first("words").alias("words"), F.first("path").alias("path"))
    none = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        none.alias("k1"), none.alias("k2"), "conv_id", "n_convs", none.alias("depth"), F.lit(None).cast("long").alias("u1"),
        F.lit(None).cast("long").alias("u2"), none.alias("words"), F.array().cast(below.schema["path"].dataType).alias("path"))
    return store(below.union(root), "nodes")


# --- rollup -------------------------------------------------------------------------

def _climb(values: DataFrame) -> DataFrame:
    """Sums of ``values`` (path, and SUMS) per node of the paths."""
    return (values.select(F.explode("path").alias("p"), *SUMS).groupBy(F.col("p.k1").alias("k1"), F.col("p.k2").alias("k2"))
            .agg(*[F.sum(c).alias(c) for c in SUMS]))


def _tops(rows: DataFrame) -> DataFrame:
    """The nodes of ``rows`` (conv_id, i, k1, k2): i, the path within the band, and the node before it."""
    band = Window.partitionBy("conv_id", F.floor(F.col("i") / BAND)).orderBy("i")
    before = rows.select("conv_id", (F.col("i") + 1).alias("i"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    full = rows.withColumn("path", F.collect_list(F.struct(*KEY)).over(band)).join(before, ["conv_id", "i"], "left")
    return store(full.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("i", "path", "u1", "u2")]), "tops")


def roll_up(nodes: DataFrame, values: DataFrame, rows: DataFrame) -> DataFrame:
    """Totals of each node's subtree: (k1, k2, SUMS), stored.

    ``nodes``: k1, k2, i (depth from 0), path (names of its band from the top to
    itself), u1, u2 (the node above); ``values``: the nodes' own SUMS; ``rows``:
    (conv_id, i, k1, k2) of all conversations at this level.
    """
    within = store(_climb(values.join(nodes.select(*KEY, "path"), KEY)), "within")
    if (nodes.agg(F.max("i")).first()[0] or 0) < BAND:
        return within
    top_rows = rows.filter(F.col("i") % BAND == 0).select("conv_id", F.floor(F.col("i") / BAND).alias("i"), *KEY)
    tops = _tops(top_rows)
    done = roll_up(tops, within.join(tops.select(*KEY), KEY, "left_semi"), top_rows)
    handed = (done.join(nodes.filter("i > 0").select(*KEY, "u1", "u2"), KEY)
              .groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(*[F.sum(c).alias(c) for c in SUMS]))
    passed = _climb(handed.join(nodes.select(*KEY, "path"), KEY))
    return store(within.unionByName(passed).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]), "totals")


# --- members that end at a node -------------------------------------------------------

def _id_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range as comma-joined ids, at most IDS a row."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        out = [(*key, ids[a], ",".join(map(str, ids[a:min(a + IDS, end)])).encode())
               for key, start, end in runs(batch, KEY) for a in range(start, end, IDS)]
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()])],
            names=[*KEY, "first_id", "ends_sha256"])


def _ends(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which a conversation ends."""
    none = F.lit(0).cast("long")
    ends = prefixes.filter("last").select(*KEY, "conv_id").union(
        members.filter("length = 0").select(none.alias("k1"), none.alias("k2"), "conv_id"))
    lists = (in_ranges(ends, *KEY, "conv_id").select(*KEY, "conv_id")
             .mapInArrow(_id_lists, "k1 long, k2 long, first_id long, ends_sha256 binary"))
    return digest_in_order(lists, KEY, ["first_id"], ["ends_sha256"], between=b",")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (both over the subtree), ends_sha256.

    ``turns``: conv_id, depth (from 1, without gaps), digest, words, last; ``members``:
    conv_id, length. Runs its rounds when called; their tables lie in the shared folder.
    """
    prefixes = _prefixes(turns)
    nodes = _nodes(prefixes, members)
    children = nodes.filter("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    known = store(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))),
                  "known")
    values = known.select(*KEY, "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    level = [(F.col("depth") - 1).alias("i"), *KEY]
    below = roll_up(nodes.filter("depth > 0").select(*level, "path", "u1", "u2"),
                    values.filter("depth > 0").drop("depth"), prefixes.select("conv_id", *level))
    first = below.join(nodes.filter("depth = 1").select(*KEY), KEY, "left_semi").select(*SUMS)
    root = values.filter("depth = 0").select(*SUMS).union(first).agg(*[F.sum(c).alias(c) for c in SUMS])
    totals = below.union(root.select(F.lit(0).cast("long"), F.lit(0).cast("long"), *SUMS))
    parents = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(totals, KEY).join(_ends(prefixes, members), KEY, "left").join(parents, ["u1", "u2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *SUMS,
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (``share_heads``)."""
    prepare(conversations.sparkSession)
    return trie(*share_heads(conversations))
