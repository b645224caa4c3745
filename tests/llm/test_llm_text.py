"""BPE, licences, quality, language, toxicity and WARC: brute force, round trips, held-out accuracy."""

import gzip
import hashlib
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from brute import (MEDIUM, SMALL, alnum, base_counts, hard_docs, hard_texts, ordered, phrases, rows_of)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from disputelens.llm import bpe, langid, license_scan, quality_qda, quality_rules, toxicity, warc
from disputelens.llm.common import Rolling
from disputelens.llm.textstats import TextStats

PATH = public_tokenizers.path("word_bpe_49k.json")
QUERIES = ("op2_warc", "op4_language", "op5_quality", "op6_quality_rules", "op7_license", "op9_bpe", "op10_toxicity")


def table(spark, name, sf_dir=SMALL):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("key", QUERIES)
def test_query_returns_every_row(spark, key):
    source, name = ("pages", "page_id") if key == "op2_warc" else ("documents", "doc_id")
    got = E.queries()[key](spark, SMALL)
    assert rows_of(got, name) == rows_of(table(spark, source), name)


# --- op9 -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected_digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_hard_cases(spark, library):
    got = rows_of(bpe.digests(hard_docs(spark), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == ordered([(i, *expected_digest(library, t)) for i, t, _ in hard_texts()])
    assert bpe.digests(hard_docs(spark).limit(0), PATH).count() == 0


def test_bpe_whole_table(spark, library):
    docs = table(spark, "documents")
    want = ordered([(r.doc_id, *expected_digest(library, r.text)) for r in docs.collect()])
    assert rows_of(bpe.digests(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()}
    assert ordered([(i, len(x)) for i, x in ids.items()]) == [w[:2] for w in want]


def random_texts(seed, n):
    r = random.Random(seed)
    pool = [*"abcde 'sStT\t\n\x0b\x85\xa0ᰜ\x1c​İΣς²½٣éèñß北京日本語😀🇫🇷!!!ǄⅣẞ", "<|endoftext|>", "'re", "'LL", " the", "é", "a࣓⃰"]
    any_char = lambda: chr(r.choice([r.randint(0, 0x2FFF), r.randint(0, 0xD7FF), r.randint(0x10000, 0x1FFFF)]))
    return ["".join(r.choice(pool) if r.random() < 0.9 else any_char() for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_bpe_random_texts(library):
    texts = random_texts(1, 1500) + ["a" * 5000, "thethe" * 300, "!?" * 400, "é" * 300, "ab" * 64, "ab" * 65]
    for text, (ids, decoded) in zip(texts, bpe.vocabulary(PATH).texts(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(map(int, ids.split())) == want
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_round_trip():
    """Without white space, the decoded tokens give back the normalised text."""
    vocab = bpe.vocabulary(PATH)
    byte_of = vocab.byte_of
    texts = ["Hello World! 123 ünïcödé", "日本語 テキスト", "it's we'll"]
    for text, (_, decoded) in zip(texts, vocab.texts(texts)):
        raw = bytes(byte_of[c] for c in decoded.replace("</w>", "").replace(" ", ""))
        assert raw.decode() == unicodedata.normalize("NFC", text).lower().replace(" ", "")


def test_rows_and_own_trees_agree():
    vocab = bpe.vocabulary(PATH)
    r = random.Random(4)
    words = ["".join(r.choice("thean ing"[:8]) for _ in range(r.randint(1, 120))).encode() for _ in range(400)]
    assert vocab.encode_words(words) == [vocab.merge_one(w) for w in words]


def test_segment_tree_root_is_least():
    r = random.Random(2)
    values = [r.randint(0, 99) for _ in range(37)]
    tree = bpe.SegmentTree(list(values))
    for _ in range(200):
        i = r.randrange(37)
        values[i] = r.randint(0, 99)
        tree.set(i, values[i])
        assert tree.root() == min(values)


def test_cache_stays_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    vocab = bpe.Vocabulary(PATH)
    texts = ["one two three four five six", "six five four", "one"]
    for _ in range(2):
        assert [i for i, _ in vocab.texts(texts)] == [
            " ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]
    assert len(vocab.known) == 3


# --- op7 -----------------------------------------------------------------------

BASE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_base(spark):
    texts = hard_texts() + [
        (200 + i, t, "en") for i, t in enumerate([
            "apache license apache license", "APACHE  License!", "cc by-nc cc BY", "gnu general public licenses",
            "Released under the MIT License. " * 3, "apache\x00license", "gnu gnu general public license"])]
    got = license_scan.scan(hard_docs(spark, texts))
    assert rows_of(got, *BASE_COLUMNS) == ordered([(i, *phrases(t)) for i, t, _ in texts])
    assert license_scan.scan(hard_docs(spark).limit(0)).count() == 0


def test_license_whole_table_base(spark):
    docs = table(spark, "documents", MEDIUM)
    got = rows_of(license_scan.scan(docs), *BASE_COLUMNS)
    assert got == ordered([(r.doc_id, *phrases(r.text)) for r in docs.collect()])


def test_license_spans(spark):
    notices = dict(license_scan.TEMPLATES)
    mit = notices["mit-notice"].split()
    inserted = " ".join([*mit[:12], "extra", "words", *mit[12:]])
    cases = {
        1: ("before " + notices["mit-notice"] + " after", "mit-notice"), 2: (inserted, "mit-notice"),
        3: (" ".join(mit[:10]), ""), 4: (notices["gpl-notice"], "gpl,gpl-notice"),
        5: ("Licensed under the Apache License, Version 2.0.", "apache,apache-short"),
        6: ("some text. All rights reserved.", "all-rights-reserved"), 7: ("all the rights are reserved", ""),
        8: (" x ".join(mit), ""),
    }
    got = license_scan.scan(hard_docs(spark, [(i, t, "en") for i, (t, _) in cases.items()]))
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.labels for i, r in found.items()} == {i: want for i, (_, want) in cases.items()}
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[1].score == 1.0 and found[3].score == 0.0 and 0.75 <= found[2].score <= 1


def test_license_short_notices_side_by_side(spark):
    released = "Released under the MIT License"
    cases = {
        1: ("All rights reserved. All rights reserved.", "all-rights-reserved"),
        2: ("All rights reserved. " * 30, "all-rights-reserved"),
        3: ("All rights reserved - all rights reserved", "all-rights-reserved"),
        4: ("All rights reserved, x all rights reserved", "all-rights-reserved"),
        5: ("Licensed under CC BY. Licensed under CC BY.", "cc-by,cc-short"),
        6: (f"{released}. {released}.", "mit,mit-short"),
        7: ("rights reserved all rights reserved all", "all-rights-reserved"),
        8: ("all rights, rights reserved", ""),
        # an occurrence with two words inserted, and the end of another
        9: ("Licensed under the Apache x y License, Version 2.0 Apache License, Version 2.0", "apache,apache-short"),
    }
    got = license_scan.scan(hard_docs(spark, [(i, t, "en") for i, (t, _) in cases.items()]))
    assert rows_of(got, "doc_id", "labels") == [(i, label) for i, (_, label) in cases.items()]
    assert {r[1] for r in rows_of(got.filter("labels <> ''"), "doc_id", "score")} == {1.0}


def test_license_plan_is_native(spark):
    plan = license_scan.scan(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- op6 -----------------------------------------------------------------------

OP6 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def labels_of(spark, rows, columns="doc_id long, quality int, toxic int, text string"):
    return spark.createDataFrame([(*r, "clash") for r in rows], columns)


LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (12, 0, 1), (15, 0, 0), (None, 1, 1), (13, None, 0), (99999, 1, 1)]


def test_rules_hard_cases(spark):
    texts = hard_texts() + [(300, "a # b\r\n" * 30 + "tail *|<>%$&", "en"), (301, "p q r " * 17, "en"),
                            (302, " ".join(f"u{i}" for i in range(49)), "en"), (303, "l1\n l1\nl1 \nl1\n\n\n", "en")]
    got = quality_rules.judge(hard_docs(spark, texts), labels_of(spark, LABELS))
    assert rows_of(got, *OP6) == ordered([(i, *base_counts(t)) for i, t, _ in texts])
    assert got.filter("kept and base_failed").count() == 0
    assert got.filter("kept <> (not base_failed and score >= -0.1)").count() == 0


def test_rules_whole_table_and_verdict(spark):
    docs, labels = table(spark, "documents", MEDIUM), table(spark, "labels", MEDIUM)
    got = quality_rules.judge(docs, labels)
    assert rows_of(got, *OP6) == ordered([(r.doc_id, *base_counts(r.text)) for r in docs.collect()])
    seen = got.join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    shares = dict(map(tuple, seen.collect()))
    assert shares[1] > 0.97 and shares[0] < 0.4


def test_rules_weights_by_hand(spark):
    docs = hard_docs(spark, [(1, "good good word", "en"), (2, "bad word", "en")])
    w = quality_rules.fit_weights(docs, labels_of(spark, [(1, 1, 0), (2, 0, 0)]))
    bucket, _ = quality_rules.ngram_buckets(TextStats([b"good bad word"], Rolling()))
    good, bad, word = w[bucket[:3]]
    n = quality_rules.BUCKETS * quality_rules.SMOOTHING
    ratio = lambda t, r: np.log((t + 0.5) / (n + 5)) - np.log((r + 0.5) / (n + 8))
    assert np.allclose([good, bad, word], [ratio(2, 2), ratio(0, 1), ratio(1, 2)])


def test_rules_without_labels_or_rows(spark):
    docs, none = hard_docs(spark), labels_of(spark, [])
    got = quality_rules.judge(docs, none)
    assert got.filter("kept = base_failed").count() == 0
    assert quality_rules.judge(docs.limit(0), none).count() == 0


# --- op4, op5, op10 ----------------------------------------------------------------

def held_out(i, folds, fold):
    import zlib

    return i is None or zlib.crc32(str(i).encode()) % folds == fold


def test_language_accuracy(spark):
    docs = table(spark, "documents", MEDIUM)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97


def test_language_hard_cases(spark):
    docs = hard_docs(spark)
    got = langid.identify(docs).collect()
    assert len(got) == len(hard_texts())
    letters = {i: any(c.isalpha() for c in t or "") for i, t, _ in hard_texts() if i is not None}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got if r.doc_id is not None)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.identify(docs.limit(0)).count() == 0
    unlearned = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in unlearned)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, ok in letters.items() if ok} | {None}


def test_language_uses_the_text_only(spark):
    docs = table(spark, "documents").filter("doc_id < 60")
    a = rows_of(langid.identify(docs), "doc_id", "lang_pred", "score")
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert rows_of(langid.identify(wrong.withColumn("source", F.lit("x"))), "doc_id", "lang_pred", "score") == a


def accuracy(spark, module, label):
    docs, labels = table(spark, "documents", MEDIUM), table(spark, "labels", MEDIUM)
    got = module.classify(docs, labels).join(labels, "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    return sum(r.predicted == r[label] for r in test) / len(test)


def test_quality_accuracy(spark):
    assert accuracy(spark, quality_qda, "quality") > 0.95


def test_toxicity_accuracy(spark):
    assert accuracy(spark, toxicity, "toxic") > 0.85


@pytest.mark.parametrize("module,folds,fold", [(quality_qda, 3, 1), (toxicity, 5, 0)])
def test_classifier_hard_cases(spark, module, folds, fold):
    docs, labels = hard_docs(spark), labels_of(spark, LABELS)
    got = module.classify(docs, labels).collect()
    assert len(got) == len(hard_texts())
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id, folds, fold) for r in got)
    none = module.classify(docs, labels_of(spark, [])).collect()
    assert {r.score for r in none} == {0.5}
    assert module.classify(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("module,label", [(quality_qda, "quality"), (toxicity, "toxic")])
def test_classifier_never_reads_held_out_labels(spark, module, label):
    docs = table(spark, "documents")
    labels = table(spark, "labels")
    folds, fold = (3, 1) if module is quality_qda else (5, 0)
    out = F.crc32(F.col("doc_id").cast("string")) % folds == fold
    turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    a = rows_of(module.classify(docs, labels), "doc_id", "score")
    assert rows_of(module.classify(docs, turned), "doc_id", "score") == a


def test_discriminant_against_densities():
    r = np.random.default_rng(1)
    k = len(quality_qda.FEATURES)
    sums, means = np.zeros((2, k + 1, k + 1)), []
    for c in (0, 1):
        x = np.hstack([np.ones((500, 1)), r.normal(c, 1 + c, (500, k))]) * quality_qda.SCALE
        sums[c] = x.T @ x
        means.append(x[:, 1:].mean(axis=0) / quality_qda.SCALE)
    model = quality_qda.Discriminant(sums)
    x = r.normal(0.5, 1, (20, k))
    density = []
    for c in (0, 1):
        m = sums[c] / quality_qda.SCALE**2 / 500
        cov = m[1:, 1:] - np.outer(means[c], means[c])
        cov = (1 - quality_qda.SHRINKAGE) * cov + np.diag(quality_qda.SHRINKAGE * np.diag(cov) + quality_qda.FLOOR)
        d = x - means[c]
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30))))


def test_ftrl_learns_sparse_weights(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 1.0)
    r = np.random.default_rng(1)
    y = (r.random(600) < 0.3).astype(int)
    rows = [np.unique(np.concatenate([r.integers(10, 5000, 30), [1 if t else 2]])) for t in y]
    w, bias = toxicity.ftrl(rows, y.tolist())
    p = np.array([w[x].sum() + bias for x in rows]) > 0
    assert (p == y).mean() > 0.97 and w[1] > 0 and (w != 0).sum() < 2500


# --- op2 -----------------------------------------------------------------------

def page_rows():
    big, other = "<p>é" + "x" * 1500, "y" * 999
    return [(1, "http://a.example/1", big), (5, "http://a.example/5?q=1#f", big), (3, None, big), (3, "u", big),
            (None, "http://n.example/", big), (7, "", None), (8, "http://b.example", ""), (9, "x\r\ny", other),
            (10, "http://c.example/", other), (11, "http://d.example", "z" * 1000), (12, "http://d.example", "z" * 1000),
            (13, "http://e.example/", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60), (14, "http://f.example/", "\r\n\r\n" * 300)]


def test_warc_hard_cases(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, row int")
    got = rows_of(warc.captures_of(pages.repartition(3)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        keeper = max(same, default=None)
        revisit = len(data) >= 1000 and page != keeper and keeper is not None
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                     keeper if revisit else None))
    assert got == ordered(want)
    assert warc.captures_of(pages.limit(0)).count() == 0


def test_warc_repeated_rows_and_null_ids(spark):
    text = "q" * 2000
    pages = spark.createDataFrame([(4, "u", text), (4, "u", text), (2, "u", text)], "page_id long, url string, html string")
    got = rows_of(warc.captures_of(pages), "page_id", "record_type", "refers_to")
    assert got == ordered([(2, "revisit", 4), (4, "response", None), (4, "response", None)])
    nulls = spark.createDataFrame([(None, "u", text)] * 2, "page_id long, url string, html string")
    assert rows_of(warc.captures_of(nulls), "page_id", "record_type") == [(None, "response")] * 2


def test_warc_files_read_back_whole(spark, tmp_path):
    pages = spark.createDataFrame([r for r in page_rows()], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path).collect()
    assert sorted(r.type for r in records) == sorted(
        ["request"] * 13 + ["metadata"] * 13 + ["response"] * 8 + ["revisit"] * 5)
    bodies = sorted(bytes(r.payload).decode() for r in records if r.type == "response")
    assert len(bodies) == 8 and bodies[-1] == "z" * 1000
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(captures) == 13
    for c in captures:
        assert c.request.type == "request" and c.metadata.type == "metadata"
        if c.capture.type == "response":
            assert c.capture.payload_digest_header == f"sha1:{c.capture.payload_digest}"
        else:
            assert c.capture.refers_to in {r.record_id for r in records if r.type == "response"}


def test_warc_members_and_bad_archives(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    (tmp_path / "b.warc").write_bytes(one)
    assert warc.read_records(spark, str(tmp_path)).filter("type = 'resource' and payload_bytes = 4").count() == 3
    assert warc.assemble(warc.read_records(spark, str(tmp_path))).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(one[:-8]))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"nothing\r\n\r\n"))


def test_lone_capture_has_null_sides(spark):
    raw = [("response", "<r1>", None), ("request", "<q1>", "<r2>"), ("revisit", "<r2>", None), ("metadata", "<m2>", "<r2>"),
           ("metadata", "<m1>", "<r2>"), ("metadata", "<m9>", "<gone>")]
    records = spark.createDataFrame(raw, "type string, record_id string, concurrent_to string")
    got = {r.record_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    assert got["<r1>"].request is None and got["<r1>"].metadata is None
    assert got["<r2>"].request.record_id == "<q1>" and got["<r2>"].metadata.record_id == "<m1>"


def test_words_of_both_classes():
    from disputelens.llm.common import ALNUM, Rolling, Words

    texts = [t or "" for _, t, _ in hard_texts()]
    w = Words([t.encode() for t in texts], ALNUM, lower=True, rolling=Rolling())
    for k, t in enumerate(texts):
        span = range(w.range[k], w.range[k + 1])
        assert [w.raw[w.starts[i]:w.ends[i]].decode() for i in span] == alnum(t)


def test_rules_scores_by_plain_counts(spark, monkeypatch):
    """Weights and scores from counts made one text at a time; a crowded bitmap of ids changes nothing."""
    texts = hard_texts()
    labels = labels_of(spark, LABELS)
    docs = hard_docs(spark, texts)
    trusted = {d for d, quality, _ in LABELS if quality == 1}
    target, raw = [np.full(quality_rules.BUCKETS, quality_rules.SMOOTHING) for _ in range(2)]
    buckets = []
    for doc, text, _ in texts:
        found, _ = quality_rules.ngram_buckets(TextStats([(text or "").encode()], Rolling()))
        buckets.append(found)
        np.add.at(raw, found, 1)
        if doc is not None and doc in trusted:
            np.add.at(target, found, 1)
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((d is None, d or 0, round(float(weights[b].sum()) / max(len(b), 1), 9))
                  for (d, _, _), b in zip(texts, buckets))
    for bits in (quality_rules.ID_BITS, 1 << 15):
        monkeypatch.setattr(quality_rules, "ID_BITS", bits)
        got = quality_rules.judge(docs, labels).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in got) == want


def test_known_words_take_little_memory(monkeypatch):
    """Python workers are kept from stage to stage, and each holds its words meanwhile."""
    vocab = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(vocab, "encode_words", lambda words: [[300, 301]] * len(words))
    for a in range(0, 400_000, 50_000):
        assert len(vocab.learn({f"word{i}" for i in range(a, a + 50_000)})) == 50_000
    held = sys.getsizeof(vocab.known) + sum(sys.getsizeof(x) for w, v in vocab.known.items() for x in (w, v, *v))
    assert held < 64 << 20
