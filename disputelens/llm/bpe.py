"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as its byte symbols. The leaves of a segment tree hold, for each
adjacent pair, (merge rank, position), or "none"; each node holds the least of
its children, so the root is the leftmost pair of the lowest rank. A merge
changes three leaves (the pair itself, the pair on its left, and the pair that
vanishes on its right), each with a path of log n nodes. It ends when the root is
"none".

The trees of many words of like length are numpy matrices, one row per word,
and each step merges one pair in every row that still has one. Words longer
than ``LONG`` symbols get a tree of their own. Spark deals out the documents; a
task splits its texts, encodes each word it has not met yet, and keeps the
results of the last ``CACHE_WORDS`` words at most.

The vocabulary is a tokenizer file (its path is a parameter): NFC, white space
runs to one space, lower case, words by the file's pattern, byte symbols with an
end-of-word suffix, no decoder, so a decoded text is its tokens joined by spaces.

Defined cases: a null or empty text, or one of white space only, has no tokens
and decodes to the empty string; the special tokens' own strings in a text
become their ids, as the library does; repeated rows are each returned. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from disputelens.llm.common import prepare, text_chunks

LONG = 128
#: Words that a worker keeps (some 300 bytes each): workers outlive the stage, and hold them while later steps run.
CACHE_WORDS = 150_000
CHUNK_BYTES = 1 << 20
NONE = np.int64(2**62)
SUFFIX = "</w>"
#: White space of the file's pattern engine (fixed values).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile(rf"{_SHORT}|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")
ALL_WORDS = regex.compile(rf"{_SHORT}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next free one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    own = set(prints)
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class SegmentTree:
    """Least value over positions; ``set`` updates one leaf and its path."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.node = [int(NONE)] * self.size + values + [int(NONE)] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def set(self, at: int, value: int) -> None:
        i = self.size + at
        self.node[i] = value
        while i > 1:
            i >>= 1
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])


class Vocabulary:
    """Token ids, merge ranks and word encoding of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + SUFFIX] for s in symbols], dtype=np.int64)
        self.width = max(self.token) + 2
        self.merged = np.empty(len(spec["model"]["merges"]), dtype=np.int64)
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank.setdefault(vocab[a] * self.width + vocab[b], rank)
            self.merged[rank] = vocab[a + b]
        self.pair_keys = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter only, for odd characters
        self.agreed: set[str] = set(map(chr, range(128)))
        self.known: dict[str, tuple[str, str]] = {}

    # --- merges -------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE without one (ids of -1 never merge)."""
        key = np.where((left < 0) | (right < 0), -1, left * self.width + right)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """Encode words of at most LONG bytes; one matrix row per word."""
        n, longest = len(words), max(map(len, words))
        size = 1 << max(1, longest - 1).bit_length()
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        symbol = np.full((n, size + 2), -1, dtype=np.int64)
        symbol[row, col] = np.where(col == length[row] - 1, self.final[flat], self.inner[flat])
        after = np.tile(np.arange(1, size + 3), (n, 1))
        before = np.tile(np.arange(-1, size + 1), (n, 1))
        alive = symbol >= 0

        tree = np.full((n, 2 * size), NONE)
        place = np.arange(size)
        r = self.ranks(symbol[:, :size], symbol[:, 1:size + 1])
        tree[:, size:] = np.where(r == NONE, NONE, r * size + place)
        level = size
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % size
            gone = after[rows, at]
            then = after[rows, gone]
            symbol[rows, at] = self.merged[root // size]
            symbol[rows, gone] = -1
            alive[rows, gone] = False
            after[rows, at] = then
            inside = then < size + 2
            before[rows[inside], then[inside]] = at[inside]
            prev = before[rows, at]
            has_prev, has_next = prev >= 0, then < size + 1
            right = self.ranks(symbol[rows, at], np.where(has_next, symbol[rows, np.minimum(then, size + 1)], -1))
            left = self.ranks(np.where(has_prev, symbol[rows, prev], -1), symbol[rows, at])
            # the vanished pair's leaf first: no other leaf of the row is at its place
            leaf_rows = np.concatenate([rows, rows, rows[has_prev]])
            leaf = np.concatenate([np.minimum(gone, size - 1), at, prev[has_prev]])
            value = np.concatenate([np.full(len(rows), NONE), np.where(right == NONE, NONE, right * size + at),
                                    np.where(left == NONE, NONE, left * size + prev)[has_prev]])
            node = size + leaf
            tree[leaf_rows, node] = value
            while node[0] > 1:
                node >>= 1
                tree[leaf_rows, node] = np.minimum(tree[leaf_rows, 2 * node], tree[leaf_rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        out = symbol[alive].tolist()
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends)]

    def merge_one(self, word: bytes) -> list[int]:
        """Encode one long word with a tree of its own."""
        n = len(word)
        symbol = [*self.inner[list(word[:-1])].tolist(), int(self.final[word[-1]])] if n > 1 else [int(self.final[word[0]])]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def leaf(a: int) -> int:
            b = after[a] if a >= 0 else n
            rank = self.rank.get(symbol[a] * self.width + symbol[b]) if b < n else None
            return int(NONE) if rank is None else rank * n + a

        tree = SegmentTree([leaf(i) for i in range(n)])
        while (root := tree.root()) < NONE:
            at = root % n
            gone = after[at]
            symbol[at] = int(self.merged[root // n])
            symbol[gone] = -1
            after[at] = after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            tree.set(gone, int(NONE))
            tree.set(at, leaf(at))
            if before[at] >= 0:
                tree.set(before[at], leaf(before[at]))
        return [s for s in symbol if s >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, in order."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_one(w)
            else:
                by_size.setdefault(max(1, len(w) - 1).bit_length(), []).append(i)
        for bits, members in by_size.items():
            step = max(1, (1 << 17) >> bits)  # rows whose matrices stay small
            for k in range(0, len(members), step):
                part = members[k:k + step]
                for i, ids in zip(part, self.merge_rows([words[i] for i in part])):
                    out[i] = ids
        return out

    # --- texts --------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens stand as themselves."""
        if self.special_split is not None and "<|" in text:
            out = []
            for part in self.special_split.split(text):
                out.extend([part] if part in self.special else self.split(part))
            return out
        return self.split(text)

    def split(self, text: str) -> list[str]:
        """Normalise and split one text as the tokenizer file says."""
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        odd = set(text) - self.agreed
        for ch in odd:
            probe = f"a{ch}a!{ch}!1{ch}1 {ch} "
            # marks that normalisation may reorder depend on their neighbours: always the library
            if not unicodedata.combining(ch) and split_words(probe) == self.library_split(probe):
                self.agreed.add(ch)
        return split_words(text) if odd <= self.agreed else self.library_split(text)

    def library_split(self, text: str) -> list[str]:
        """The library's own words, for characters that its Unicode tables know otherwise than Python's."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8") for w, _ in words]

    def learn(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """(ids, tokens), both joined by spaces, of each word; encodes those not met yet.

        The first CACHE_WORDS words met stay known; later ones are encoded again
        when they come again, so memory stays bounded and frequent words stay.
        """
        known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in known]
        for w, ids in zip(new, self.encode_words([w.encode("utf-8") for w in new])):
            if w in self.special:
                ids = [self.special[w]]
            known[w] = " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])
        for w in new[:CACHE_WORDS - len(self.known)]:
            self.known[w] = known[w]
        return known

    def texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by spaces, decoded text) of each text."""
        split = [self.pieces(t) for t in texts]
        known = self.learn(set().union(*split))
        for words in split:
            ids, tokens = zip(*map(known.__getitem__, words)) if words else ((), ())
            yield " ".join(ids), " ".join(tokens)


def split_words(text: str) -> list[str]:
    # lower case is by character there: a final capital sigma is not special
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return ALL_WORDS.findall(text)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, str]]]]:
    vocab = vocabulary(path)
    for rows, texts in text_chunks(batches, "text", CHUNK_BYTES):
        yield rows, list(vocab.texts([t.decode("utf-8") for t in texts]))


def _ids_and_text(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, done in _encoded(batches, path):
            ids = pa.array([list(map(int, i.split())) for i, _ in done], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.drop_columns(["text"]).columns, ids,
                                              pa.array([d for _, d in done], type=pa.string())],
                                             names=[*rows.drop_columns(["text"]).schema.names, "ids", "decoded"])
    return run


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for rows, done in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array([i.count(" ") + 1 if i else 0 for i, _ in done], type=pa.int64()),
                 pa.array([sha(i) for i, _ in done]), pa.array([sha(d) for _, d in done])],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (token ids), decoded (the text that the ids stand for)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_ids_and_text(path), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` returns, as digests made in the task."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_digests(path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           ).withColumnRenamed("id", id_col)
