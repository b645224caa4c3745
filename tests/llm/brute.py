"""Plain Python versions of the operators' contracts, and inputs that are hard on them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "row long, id string, name string, score double, kept boolean, label int, n long, hits string")


def lower_az(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text: str | None) -> list[str]:
    return ALNUM.findall(lower_az(text))


def spaced(text: str | None) -> list[str]:
    return SPACED.findall(lower_az(text))


PASSAGE = " ".join(f"passage{i} über the word{i * 7 % 13}" for i in range(40))
BASE = " ".join(f"w{i}" for i in range(60))


def hard_texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, lang): nulls, empty and long texts, repeated rows, near copies, ties."""
    words = BASE.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    return [
        (1, BASE, "en"), (2, BASE, "en"), (2, BASE, "en"), (3, near, "en"), (None, BASE, None), (None, near, "en"),
        (4, None, "en"), (5, "", "de"), (None, None, None), (6, " \t\n\r\x0b\x0c", "de"), (7, "!!! ... ###", "fr"),
        (8, "a b c", "fr"), (9, "A B C", "fr"), (10, "a b c d", "es"), (11, "x " * 400, "es"),
        (12, "y" * 3000, "en"), (13, "Früh " + PASSAGE + " ende", "de"), (14, "Ander\n" + PASSAGE + "\nschluß", "de"),
        (15, "word " * 20_000 + "tail", "en"), (16, "日本語 текст ǅ İstanbul ΑΣ", "en"),
        (17, "line one\nline one\nline two\n\nline one", "en"), (18, "x" * 199, "en"), (19, "x" * 200, "en"),
        (20, "<|endoftext|> it's <|startoftext|>'LL", "en"), (21, "GNU General Public License. CC BY, mit license", "en"),
        (22, "one\x00two\x7fthree", "en"), (23, BASE.upper(), "en"),
    ]


def hard_docs(spark: SparkSession, texts=None) -> DataFrame:
    rows = [(i, t, lang, "s", len(t or ""), 7, "clash", "clash", 0.5, True, 1, 3, "clash")
            for i, t, lang in (hard_texts() if texts is None else texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    """Sorted tuples, nulls first."""
    found = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))


# --- op1 ---------------------------------------------------------------------------

def decontaminate(docs, items, window=10) -> list[tuple]:
    windows = set()
    for item, text in items:
        w = alnum(text)
        n = min(window, len(w))
        if n:
            windows |= {(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1)}
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for item, words in windows:
            n = len(words)
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == words:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return ordered(out)


# --- op3 ---------------------------------------------------------------------------

def removed(texts: list[bytes], length=200) -> list[list[tuple[int, int]]]:
    """Runs to remove from each text."""
    places: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            places[t[i:i + length]] = places.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        runs: list[list[int]] = []
        for i in range(len(t) - length + 1):
            if places[t[i:i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append([(a, b) for a, b in runs])
    return out


# --- op6 ---------------------------------------------------------------------------

def base_counts(text: str | None) -> tuple:
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times: dict[tuple, int] = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    repeat = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(repeat), failed)


# --- op7 ---------------------------------------------------------------------------

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def phrases(text: str | None) -> tuple:
    words = alnum(text)
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


# --- op8 ---------------------------------------------------------------------------

def shingles(text: str | None) -> frozenset:
    w = spaced(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def components(docs) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(docs):
        same = [d for j, (d, _) in enumerate(docs) if root(j) == root(i) and d is not None] if sets[i] else [doc]
        least = min((d for d in same if d is not None), default=None)
        out.append((doc, len(sets[i]), least, doc is not None and doc == least))
    return ordered(out)
