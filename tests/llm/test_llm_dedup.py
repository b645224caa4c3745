"""Near-duplicates, repeated substrings and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
from brute import (BASE, PASSAGE, SMALL, components, decontaminate, hard_docs, hard_texts, ordered, removed, rows_of,
                   shingles)

import __spark_entry__ as E
from disputelens.llm import decontam, minhash, queries, suffix_dedup
from disputelens.oracle.compare import compare


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, duck_small, key):
    ok, msg = compare(E.queries()[key](spark, SMALL), duck_small, E.oracle_sql()[key])
    assert ok, msg


# --- op1 -----------------------------------------------------------------------

OP1 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, words string")


ITEMS = [(1, BASE), (1, BASE), (10, BASE), (2, "a b c"), (3, "A b"), (4, None), (5, ""), (6, "?!"), (None, "x x x"),
         (7, " ".join(PASSAGE.split()[5:30])), (8, "x x x x"), (9, "nowhere to be found in any document at all, truly so"),
         (11, "one")]


def test_decontaminate_hard_cases(spark):
    got = rows_of(decontam.decontaminate(hard_docs(spark), bench(spark, ITEMS)), *OP1)
    assert got == decontaminate([(i, t) for i, t, _ in hard_texts()], ITEMS)
    assert sum(r[-1] for r in got) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_decontaminate_random(spark, seed):
    r = random.Random(seed)
    text = lambda n, m: " ".join(r.choice("abcdefg"[:m]) for _ in range(n))
    items = [(i, text(r.randint(0, 14), r.randint(1, 7))) for i in range(25)]
    docs = [(i, text(r.randint(0, 120), r.randint(1, 7)), "en") for i in range(40)]
    docs += [(100 + i, f"{text(9, 7)} {items[i][1]} {text(5, 7)}", "en") for i in range(25)]
    got = rows_of(decontam.decontaminate(hard_docs(spark, docs), bench(spark, items)), *OP1)
    assert got == decontaminate([(i, t) for i, t, _ in docs], items)


def test_an_item_without_id_marks_words(spark):
    items = [(None, BASE), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    got = rows_of(decontam.decontaminate(hard_docs(spark), bench(spark, items)), *OP1)
    assert got == decontaminate([(i, t) for i, t, _ in hard_texts()], items)
    assert any(r[2] >= 60 and r[3] == 1 and r[-1] for r in got)


def test_decontaminate_empty_tables(spark):
    docs, none = hard_docs(spark), bench(spark, [])
    assert decontam.decontaminate(docs.limit(0), bench(spark, ITEMS)).count() == 0
    clean = decontam.decontaminate(docs, none)
    assert clean.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert clean.count() == len(hard_texts())
    assert decontam.keep_clean(docs, none).columns == docs.columns


def test_keep_clean_drops_hit_rows_only(spark):
    docs = hard_docs(spark)
    kept = decontam.keep_clean(docs, bench(spark, ITEMS))
    want = decontaminate([(i, t) for i, t, _ in hard_texts()], ITEMS)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(r[0],) for r in want if not r[-1]]


# --- op3 -----------------------------------------------------------------------

OP3 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def expected_cuts(docs):
    texts = [(t or "").encode() for _, t, _ in docs]
    out = []
    for (doc, _, _), t, runs in zip(docs, texts, removed(texts)):
        kept = suffix_dedup.kept_bytes(t, runs)
        out.append((doc, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def repeat_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    docs = [prose(r.randint(5, 200)) for _ in range(10)]
    for s in shared:
        docs += [f"{prose(r.randint(0, 40))}{s}{prose(r.randint(0, 40))}" for _ in range(5)]
        docs.append(s[r.randint(0, 60):-r.randint(1, 60)])
    edited = docs[0].split()
    docs += [" ".join([*edited[:k], word(), *edited[k + 1:]]) for k in range(0, len(edited), 9)]
    docs += ["ab" * 300, "ab" * 101, "z" * 500, shared[0][:199], shared[0][:200], shared[0][:201], docs[3], docs[3]]
    return [(i, t, "en") for i, t in enumerate(docs)]


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_suffix_dedup_hard_cases(spark, group):
    got = rows_of(suffix_dedup.deduplicate(hard_docs(spark), group=group), *OP3)
    assert got == expected_cuts(hard_texts())


@pytest.mark.parametrize("seed,group,block", [(1, suffix_dedup.GROUP, 1 << 20), (2, 2, 1 << 20), (3, 50, 500)])
def test_suffix_dedup_random(spark, monkeypatch, seed, group, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    docs = repeat_texts(seed)
    got = rows_of(suffix_dedup.deduplicate(hard_docs(spark, docs), group=group), *OP3)
    assert got == expected_cuts(docs)
    assert sum(r[2] for r in got) > 3000


def test_a_text_column_called_name(spark):
    docs = [(i, t) for i, t, _ in repeat_texts(6)]
    df = spark.createDataFrame([(t, i) for i, t in docs], "name string, text long")
    got = rows_of(suffix_dedup.deduplicate(df, "text", "name"), "text", *OP3[1:])
    assert got == expected_cuts([(i, t, None) for i, t in docs])


def test_long_texts_in_pieces(monkeypatch):
    from disputelens.llm.common import Rolling

    monkeypatch.setattr(suffix_dedup, "_PIECE", 300)
    text = repeat_texts(5)[10][1].encode() * 3
    f = suffix_dedup.Fragments([text, b"short", text], Rolling())
    starts = [(t, s) for t, a, n in zip(f.text.tolist(), f.at.tolist(), f.n.tolist()) for s in range(a, a + n)]
    assert sorted(starts) == [(t, s) for t in (0, 2) for s in range(len(text) - 199)]


def test_positions_of_long_texts_fit_their_bits(monkeypatch):
    from disputelens.llm.common import Rolling

    text = repeat_texts(5)[10][1].encode() * 9
    whole = suffix_dedup.Fragments([text], Rolling())
    monkeypatch.setattr(suffix_dedup, "_POS_BITS", 11)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1 << 10)
    assert len(text) > 2 << 11
    f = suffix_dedup.Fragments([text, b"short", text[:300]], Rolling())
    starts = [(t, s) for t, a, n in zip(f.text.tolist(), f.at.tolist(), f.n.tolist()) for s in range(a, a + n)]
    assert sorted(starts) == [(0, s) for s in range(len(text) - 199)] + [(2, s) for s in range(101)]
    assert {len(f.flanks(i)) - n for i, n in enumerate(f.n.tolist())} == {suffix_dedup.LENGTH - suffix_dedup.CORE - 1}
    keys = dict(zip((f.at + f.left).tolist(), f.core_key.tolist()))
    assert len(set(keys.values())) == len({text[a:a + suffix_dedup.CORE] for a in keys})
    assert set(whole.core_key.tolist()) & set(keys.values())


def test_kept_texts(spark):
    docs = hard_docs(spark)
    cut = suffix_dedup.kept_texts(docs)
    assert cut.columns == docs.columns and cut.schema["text"].dataType == docs.schema["text"].dataType
    texts = [(t or "").encode() for _, t, _ in hard_texts()]
    want = [(i, None if t is None else suffix_dedup.kept_bytes(b, runs).decode("utf-8", "ignore"))
            for (i, t, _), b, runs in zip(hard_texts(), texts, removed(texts))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted([tuple(r) for r in cut.select("doc_id", "text").collect()], key=key) == sorted(want, key=key)
    assert suffix_dedup.kept_texts(docs.limit(0)).count() == 0
    assert suffix_dedup.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 40])
def test_intervals_against_common_prefixes(depth):
    r = np.random.default_rng(depth)
    for symbols in (r.integers(0, 3, 300), np.zeros(50, dtype=int), r.integers(0, 300, 400), np.tile(r.integers(0, 9, 20), 9)):
        order, place = suffix_dedup.suffix_order(symbols)
        want = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        assert order.tolist() == want and place[order].tolist() == list(range(len(symbols)))
        got = suffix_dedup.expand_intervals(symbols, order, place, depth)
        for i in range(1, len(want)):
            a, b = symbols[want[i - 1]:][:depth].tolist(), symbols[want[i]:][:depth].tolist()
            assert got[i] == (a != b or len(a) < depth)


# --- op8 -----------------------------------------------------------------------

OP8 = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_hard_cases(spark):
    docs = hard_docs(spark)
    assert rows_of(minhash.near_duplicates(docs), *OP8) == components([(i, t) for i, t, _ in hard_texts()])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def family(seed, m, n, edits):
    """One original, and m copies that each change ``edits`` words of it: mostly linked to it only."""
    r = random.Random(seed)
    words = [f"f{seed}w{i}" for i in range(n)]
    out = [" ".join(words)]
    for k in range(m):
        own = list(words)
        for i in r.sample(range(n), edits):
            own[i] = f"c{k}x{i}"
        out.append(" ".join(own))
    return out


def test_near_duplicate_families_and_chains(spark):
    texts = family(1, 40, 300, 8) + family(2, 25, 120, 3) + family(3, 10, 30, 1) + family(4, 6, 8, 1)
    words = [f"k{i}" for i in range(100)]
    for step in range(12):  # a chain: each is near the next, the ends are not near
        texts.append(" ".join([f"n{j}" for j in range(step * 3)] + words[step * 3:]))
    random.Random(5).shuffle(texts)
    docs = [(i, t, "en") for i, t in enumerate(texts)]
    got = rows_of(minhash.near_duplicates(hard_docs(spark, docs)), *OP8)
    assert got == components([(i, t) for i, t, _ in docs])


def boilerplate_family(seed, pairs):
    """Texts on one boilerplate: 0.74 to each other, but each has a partner at 0.755, by two words more."""
    out = []
    for k in range(pairs):
        same = [*(f"b{seed}w{i}" for i in range(150)), f"s{seed}p{k}x", f"s{seed}p{k}y"]
        out += [" ".join(same + [f"{side}{seed}p{k}z{i}" for i in range(24)]) for side in "ab"]
    return out


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_near_duplicates_linked_to_each_other_only(spark, monkeypatch, block):
    """A third text is the centre of most buckets that two linked texts share."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = boilerplate_family(1, 40) + boilerplate_family(2, 15) + family(6, 12, 120, 4)[1:]
    random.Random(8).shuffle(texts)
    docs = [(i, t, "en") for i, t in enumerate(texts)]
    want = components([(i, t) for i, t, _ in docs])
    assert sum(r[3] for r in want) >= 55
    assert rows_of(minhash.near_duplicates(hard_docs(spark, docs)), *OP8) == want


def test_keep_one_keeps_one_row_of_each_group(spark):
    docs = hard_docs(spark)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = components([(i, t) for i, t, _ in hard_texts()])
    groups = {r[2] for r in want if r[1]}
    empty = [r for r in want if not r[1]]
    assert kept.count() == len(groups) + len(empty)
    nulls = spark.createDataFrame([(None, BASE)] * 3, "doc_id long, text string")
    assert minhash.keep_one(nulls).count() == 1


def test_signature_estimates_similarity():
    from disputelens.llm.common import Rolling

    a, b = family(9, 1, 400, 10)
    values, offsets = minhash.shingle_sets([a.encode(), b.encode(), b"one two", b""], Rolling())
    sig = minhash.one_permutation(values, offsets)
    exact = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.15
    assert np.diff(offsets).tolist() == [len(shingles(a)), len(shingles(b)), 1, 0]
    assert len(set(sig[2].tolist())) == 1 and not sig[3].any()


def test_contract_reaches_least_node(spark):
    r = random.Random(3)
    pairs = {tuple(sorted(r.sample(range(200), 2))) for _ in range(120)} | {(i, i + 1) for i in range(300, 360)}
    got = dict(map(tuple, minhash.contract(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()))
    least = {n: n for p in pairs for n in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert minhash.contract(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contract_takes_few_rounds_for_a_sorted_chain(spark, monkeypatch):
    rounds = []
    keep = minhash.store
    monkeypatch.setattr(minhash, "store", lambda df, name="t", *a: (rounds.append(name), keep(df, name, *a))[1])
    chain = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    assert minhash.contract(chain).filter("root = 0").count() == 1001
    assert rounds.count("edges") <= 2 and rounds.count("near") <= 14


def test_sketches_bound_the_intersection():
    r = np.random.default_rng(5)
    for n in (3, 40, 900, 5000):
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 5:], r.integers(0, 2**63, n // 5, dtype=np.uint64)])
        differ = sum(int(x).bit_count() for x in (minhash.parity_sketch(a) ^ minhash.parity_sketch(b)).view(np.uint64))
        assert differ <= 2 * (n // 5) and (n > 1000 or differ > n // 5 - 1)


def test_pairs_that_cannot_link_are_not_put_out(spark):
    """A family of 150 texts at 0.74 to each other, and one linked pair: the exact join makes few rows."""
    made = []
    pairs = minhash._prefix_pairs
    try:
        minhash._prefix_pairs = lambda prefixes: (out := pairs(prefixes), made.append(out.count()))[0]
        texts = boilerplate_family(3, 75)
        docs = [(i, t, "en") for i, t in enumerate(texts)]
        got = rows_of(minhash.near_duplicates(hard_docs(spark, docs)), *OP8)
    finally:
        minhash._prefix_pairs = pairs
    assert got == components([(i, t) for i, t, _ in docs])
    assert made and made[0] < 2000  # of 11,175
