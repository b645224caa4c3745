"""The corpus pipeline: each stage on its own input against brute force, whole runs, and the entry's guard."""

import hashlib
import random
import subprocess
import sys

import public_tokenizers
import pytest
from brute import SMALL, components, decontaminate, hard_docs, removed
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from disputelens.llm import decontam, minhash, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_stage_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "repeated_passages", "decontaminated", "tokens"]
    assert all(columns == COLUMNS for columns, _ in steps[:-1])
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()


def test_language_keeps_what_has_letters(steps):
    before, after = steps[0][1], steps[1][1]
    letters = {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in after} == letters
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_duplicates_keep_one_of_each_group(steps):
    before, after = steps[1][1], steps[2][1]
    want = [c[0] for c in components([(r.doc_id, r.text) for r in before]) if c[3]]
    assert sorted(r.doc_id for r in after) == sorted(want)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_repeated_passages_are_cut(steps):
    before, after = steps[2][1], steps[3][1]
    texts = [r.text.encode() for r in before]
    want = {r.doc_id: suffix_dedup.kept_bytes(t, runs).decode("utf-8", "ignore")
            for r, t, runs in zip(before, texts, removed(texts))}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_decontaminated_documents_go(spark, steps):
    before, after = steps[3][1], steps[4][1]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r[0] for r in decontaminate([(r.doc_id, r.text) for r in before], items) if not r[-1]]
    assert sorted(r.doc_id for r in after) == sorted(clean)


def test_tokens_of_every_document(steps):
    before, after = steps[4][1], steps[5][1]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in before}
    assert {r.doc_id: list(r.ids) for r in after} == ids
    for r in after:
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        decoded = library.decode(ids[r.doc_id], skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_run_equals_the_stages(spark, steps):
    key = lambda r: r.doc_id
    assert sorted(corpus_pipeline.run(spark, SMALL).collect(), key=key) == sorted(steps[-1][1], key=key)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_hard_documents(spark, empty):
    """Nulls, repeated rows, clashing extra columns, and no rows at all."""
    docs = hard_docs(spark).limit(0) if empty else hard_docs(spark)
    columns, path_rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        path_rows = stage(spark, path_rows, SMALL)
        if name != "tokens":
            assert path_rows.columns == columns
        rows = path_rows.collect()
        path_rows = spark.createDataFrame(rows, path_rows.schema)
    assert bool(rows) != empty
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_entry_imports_without_the_subpackage(tmp_path):
    """The rest of the library and its queries work when pipeline and subpackage are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(E.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), set(q) == set(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[1:] == ["False", "True"], said.stderr


def test_stages_write_few_files_when_dealt_over_many_partitions(spark, tmp_path, monkeypatch):
    """Tables and results of small stages get files by their rows, not one for each of many nearly empty partitions."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(150)]
    family = " ".join(r.choices(words, k=60)).split()
    texts += [" ".join([*family[:i], f"x{i}", *family[i + 1:]]) for i in range(40)] + [texts[0]] * 10
    # two documents share a passage with others, and a few hold a window of an item
    passage, item = " ".join(r.choices(words, k=50)), " ".join(f"item{i}" for i in range(12))
    texts += [f"{passage} {t}" for t in texts[:20]] + [f"{t} {item}" for t in texts[20:30]]
    spark.createDataFrame([(i, t, "en", len(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(f"q{i}", " ".join(r.choices(words, k=30))) for i in range(20)] + [("q", item)],
                          "item_id string, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))

    files = {}
    for module in (minhash, suffix_dedup, decontam):
        def counted(df, name="t", *rest, keep=module.store):
            stored = keep(df, name, *rest)
            files.setdefault(name, []).append(len(stored.inputFiles()))
            return stored
        monkeypatch.setattr(module, "store", counted)
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    stages = {"near_duplicates", "repeated_passages", "decontaminated"}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = spark.read.parquet(str(tmp_path / "in"))
        for name, stage in corpus_pipeline.STAGES:
            if name in stages:
                stage(spark, docs, str(tmp_path)).write.parquet(path := str(tmp_path / name))
                docs = spark.read.parquet(path)
                files[f"result of {name}"] = [len(docs.inputFiles())]
                if name == "near_duplicates":
                    want = [c[0] for c in components(list(enumerate(texts))) if c[3]]
                    assert sorted(x.doc_id for x in docs.collect()) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"classes", "buckets", "sets", "links", "components", "cores", "spans", "windows", "found"} <= set(files)
    # the last result is an anti join of whole texts, left to Spark's partitions
    del files["result of decontaminated"]
    most = 2 * spark.sparkContext.defaultParallelism
    assert {k: max(v) for k, v in files.items() if max(v) > most} == {}
