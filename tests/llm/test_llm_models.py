"""Language profiles and the toxicity model against plain versions with the production settings."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from brute import SMALL, alnum
from pyspark.sql import functions as F

import __spark_entry__ as E
from disputelens.llm import langid, toxicity
from disputelens.llm.common import Rolling


def fold_of(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def letter(c: str) -> int:
    if not c.isalpha():
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) * 2654435761 % 2**32 % (langid.LETTERS - 27)


def profile(text: str | None) -> np.ndarray:
    """Sum over trigrams of the product of the letters' signs, each rotated by its place."""
    signs = np.random.Generator(np.random.PCG64(11)).integers(0, 2, (langid.LETTERS, langid.DIMS), dtype=np.int8) * 2 - 1
    codes = []
    for c in " " + (text or "").lower() + " ":
        if letter(c) or not codes or codes[-1]:
            codes.append(letter(c))
    found = Counter((a, b, c) for a, b, c in zip(codes, codes[1:], codes[2:]) if b)
    total = np.zeros(langid.DIMS)
    for (a, b, c), n in found.items():
        total += n * (np.roll(signs[a], 2).astype(float) * np.roll(signs[b], 1) * signs[c])
    return total


def unit(v):
    return v / max(np.linalg.norm(v), 1e-12)


def test_language_against_plain_profiles(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    vectors = {d.doc_id: profile(d.text) for d in docs}
    prototypes = defaultdict(lambda: np.zeros(langid.DIMS))
    for d in docs:
        if fold_of(d.doc_id, 5) and d.lang is not None:
            prototypes[d.lang] += np.rint(unit(vectors[d.doc_id]) * langid.UNIT)
    names = sorted(prototypes)
    got = {r.doc_id: r for r in E.queries()["op4_language"](spark, SMALL).collect()}
    assert len(got) == len(docs) and len(names) > 1
    for d in docs:
        cosines = [float(unit(vectors[d.doc_id]) @ unit(prototypes[n])) for n in names]
        row = got[d.doc_id]
        assert row.held_out == (fold_of(d.doc_id, 5) == 0)
        if not vectors[d.doc_id].any():
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        assert abs(row.score - max(0.0, min(1.0, max(cosines)))) < 1e-4
        # the prediction is the best, or level with it
        assert cosines[names.index(row.lang_pred)] > max(cosines) - 1e-4


def buckets(text: str) -> set[int]:
    return set(toxicity.hashed([text.encode()], Rolling())[0].tolist())


def test_features_are_words_pairs_and_skip_pairs():
    """A text's features are those of its windows of three words, and the three kinds are told apart."""
    one, two, skip = buckets("a"), buckets("a b"), buckets("a x b")
    assert len(one) == 1 and len(two) == 3 and len(skip) == 6
    assert one < two and len(two & skip) == 2  # the words; the pair differs from the skip pair
    assert buckets("b a") != two and buckets("A  b!") == two and not buckets("") and not buckets("!?")
    text = "The cat sat on the mat; the cat SAT on it, and then 7 dogs came by: no cat, no mat."
    words = alnum(text)
    windows = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    assert buckets(text) == set().union(*map(buckets, windows))
    both, ends = toxicity.hashed([b"a b", b"", text.encode()], Rolling())
    assert ends.tolist()[:3] == [0, 3, 3] and set(both[ends[2]:].tolist()) == buckets(text)


def plain_ftrl(rows):
    """One coordinate at a time, weights from z and n when needed; the bias is coordinate None without L1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = toxicity.L1 if i is not None else 0.0
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, label in rows:
            w = {i: weight(i) for i in [*features, None]}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values())))))
            g = (p - label) * (toxicity.POSITIVE if label else 1.0)
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return weight, [i for i in list(z) if weight(i)]


def test_toxicity_against_plain_ftrl(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter(F.col("toxic").isin(0, 1))
    features = {r.doc_id: buckets(r.text or "") for r in docs.collect()}
    train = (docs.join(labels.select("doc_id", "toxic"), "doc_id").withColumn("h", F.xxhash64("doc_id"))
             .orderBy("h", "toxic").collect())
    train = [(features[r.doc_id], int(r.toxic)) for r in train if fold_of(r.doc_id, 5)]
    assert 0 < len(train) < toxicity.MAX_TRAIN
    weight, used = plain_ftrl(train)
    assert 1 < len(used) < 0.2 * len(set().union(*(x for x, _ in train)))  # sparse
    got = E.queries()["op10_toxicity"](spark, SMALL).collect()
    assert len(got) == len(features)
    for r in got:
        margin = sum(weight(i) for i in features[r.doc_id]) + weight(None)
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))
        assert abs(r.score - want) < 1e-3
        assert r.held_out == (fold_of(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5)
