"""Cross-tokenizer alignment by an associative fragment monoid.

A byte-level BPE (A) and a sentence-piece BPE (B) encode the same bytes, a space and
the text. Offsets where tokens of both end cut them into groups. A byte range of a text
gives a fragment: what stands before the first common end (open prefix), the closed
groups, what stands after the last one (open suffix). Two neighbouring fragments compose to
one (the left suffix and the right prefix close or stay open), composition is associative,
and a text's alignment is the composition of its ranges' fragments in any bracketing:

* within a range, a word is a fragment that is closed at both ends, made once per
  distinct word of a worker; the fragments of many texts' words are rows of Arrow and numpy
  arrays, composed by taking the rows of the words in order;
* texts over ``RANGE`` bytes are dealt out as byte ranges to as many tasks and composed
  by a tree that joins ``FAN`` neighbours at a time.

Words are cut before a space that follows a character other than white space. Both
tokenizers have a token end there: A's splitter starts a part, and no piece of B holds a space
after another character (``Aligner`` checks that, and that B's normaliser keeps bytes).
A range takes the words that it touches and keeps the tokens that end in it, so a range
may cut a word's group; memory follows the longest text without a space.

Pairs linked over the whole corpus (tokens whose byte ranges overlap) are counted per
fragment and summed by Spark. The counts go back to the texts by broadcast slices of at most about
``SLICE`` pairs each, as many as the counts need, so neither common pairs nor common words
form a hot key.

Null and empty texts, and texts whose tokens don't give back space + text, have no
tokens: zeros and an empty ``groups_sha256``. Repeated rows are rows of their own, and other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.llm.bpe import byte_symbols
from disputelens.llm.common import TASK_ROWS, TEXT_ROWS, as_bytes, file_bytes, in_tasks, lists_of, prepare, store, text_chunks

#: Bytes of a range; texts up to that are one range.
RANGE = 32 << 10
#: Neighbouring fragments that one step of the tree composes.
FAN = 8
#: Linked id pairs that one broadcast holds, about.
SLICE = 500_000
#: Distinct words that a worker keeps when it holds twice as many, and words that are tokenized as one text.
WORDS = 150_000
TOGETHER = 1000
#: Bytes of texts whose words are looked up and composed together.
CHUNK = 2 << 20

_ASCII_SPACE = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)
_WIDE_SPACE = [int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 1 << 16)) if c.isspace()]
#: Fixed value: the parts into which byte-level BPE of this kind splits a text.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of \t, \n, \r, U+0020 to U+007E, and of U+00A1 to U+024F without U+00AD (see ``_latin``): Unicode tables agree on their kinds.
_LATIN = np.array([b in (9, 10, 13) or 0x20 <= b <= 0x7E or 0x80 <= b <= 0xBF or 0xC2 <= b <= 0xC9 for b in range(256)])
Tokens = list[tuple[int, int]]  # (id, end offset)


# --- fragments ----------------------------------------------------------------------

class Fragment:
    """Alignment of a byte range: open prefix, closed groups, open suffix.

    Without a common end inside, all tokens are in the prefix and ``cut`` is False.
    Tokens carry their ends only; each begins where the one before ends.
    """

    __slots__ = ("cut", "prefix", "suffix", "groups", "links", "n_a", "n_b", "n_groups", "ok")

    def __init__(self) -> None:
        self.cut, self.ok = False, True
        self.prefix: tuple[Tokens, Tokens] = ([], [])
        self.suffix: tuple[Tokens, Tokens] = ([], [])
        self.groups: list[bytes] = []  # joined by ";" they are the closed groups in order
        self.links: list[int] = []  # a * width + b of each link of the closed groups
        self.n_a = self.n_b = self.n_groups = 0

    def close(self, a: Tokens, b: Tokens, width: int) -> None:
        """Append a whole group."""
        self.groups.append((",".join(str(i) for i, _ in a) + "|" + ",".join(str(i) for i, _ in b)).encode())
        self.n_groups += 1
        i = j = 0
        while i < len(a) and j < len(b):
            self.links.append(a[i][0] * width + b[j][0])
            ends = a[i][1], b[j][1]
            i += ends[0] <= ends[1]
            j += ends[1] <= ends[0]


def fragment_of(a: Tokens, b: Tokens, width: int) -> Fragment:
    """The fragment of tokens of a byte range (those that end in it)."""
    out = Fragment()
    out.n_a, out.n_b = len(a), len(b)
    common = sorted({e for _, e in a} & {e for _, e in b})
    i = j = 0
    for k, end in enumerate(common):
        at = i, j
        while i < len(a) and a[i][1] <= end:
            i += 1
        while j < len(b) and b[j][1] <= end:
            j += 1
        part = a[at[0]:i], b[at[1]:j]
        if k:
            out.close(*part, width)
        else:
            out.cut, out.prefix = True, part
    if out.cut:
        out.suffix = a[i:], b[j:]
    else:
        out.prefix = a, b
    return out


def closed_fragment(a: Tokens, b: Tokens, width: int) -> Fragment:
    """The fragment of a range that begins at a common end: its prefix is a group."""
    out = fragment_of(a, b, width)
    if out.cut:
        first = Fragment()
        first.close(*out.prefix, width)
        out.groups, out.links = first.groups + out.groups, first.links + out.links
        out.n_groups += 1
        out.prefix = ([], [])
    return out


def compose(x: Fragment, y: Fragment, width: int) -> Fragment:
    """The fragment of two neighbouring ranges."""
    out = Fragment()
    out.ok = x.ok and y.ok
    out.n_a, out.n_b, out.n_groups = x.n_a + y.n_a, x.n_b + y.n_b, x.n_groups + y.n_groups
    out.cut = x.cut or y.cut
    between = tuple(p + q for p, q in zip(x.suffix if x.cut else x.prefix, y.prefix))
    if x.cut:
        out.prefix, out.groups, out.links = x.prefix, list(x.groups), list(x.links)
        if y.cut:
            # a group that closes where y's first common end is; empty if x ends with one and y begins with one
            if between[0] or between[1]:
                out.close(*between, width)
            out.groups += y.groups
            out.links += y.links
            out.suffix = y.suffix
        else:
            out.suffix = between
    else:
        out.prefix, out.groups, out.links = between, list(y.groups), list(y.links)
        out.suffix = y.suffix
    return out


# --- words and texts ------------------------------------------------------------------

def _offsets(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])


def _binary(data, at: np.ndarray) -> pa.Array:
    """Binary values from their bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _spans(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values and their offsets."""
    _, at, data = values.buffers()
    at = np.frombuffer(at, dtype=np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0]:at[-1]], at - at[0]


class Closed:
    """Closed fragments, a row each: groups with ";" after each, links (of row i from ``at[i]``), n_a, n_b and n_groups;
    ``ok`` is False where tokens don't give back the bytes."""

    __slots__ = ("groups", "links", "at", "counts", "ok")

    def __init__(self, groups: pa.Array, links: np.ndarray, at: np.ndarray, counts: np.ndarray, ok: np.ndarray):
        self.groups, self.links, self.at, self.counts, self.ok = groups, links, at, counts, ok

    @classmethod
    def none(cls) -> Closed:
        return cls(pa.array([], type=pa.binary()), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64),
                   np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=bool))

    @classmethod
    def concat(cls, parts: list[Closed]) -> Closed:
        return cls(pa.concat_arrays([p.groups for p in parts]), np.concatenate([p.links for p in parts]),
                   _offsets(np.concatenate([np.diff(p.at) for p in parts])), np.concatenate([p.counts for p in parts]),
                   np.concatenate([p.ok for p in parts]))

    def take(self, rows: np.ndarray) -> Closed:
        sizes = np.diff(self.at)[rows]
        at = _offsets(sizes)
        links = self.links[np.repeat(self.at[rows] - at[:-1], sizes) + np.arange(at[-1])]
        return Closed(self.groups.take(pa.array(rows)), links, at, self.counts[rows], self.ok[rows])


class Joined:
    """The closed fragment of each text, from those of its words: text i has the words from ``word_at[i]``."""

    def __init__(self, words: Closed, word_at: np.ndarray):
        totals = np.concatenate([np.zeros((1, 3), dtype=np.int64), np.cumsum(words.counts, axis=0)])
        self.n_a, self.n_b, self.n_groups = np.diff(totals[word_at], axis=0).T
        self.ok = np.diff(_offsets(~words.ok)[word_at]) == 0
        self.links, self.link_at = words.links, words.at[word_at]
        data, at = _spans(words.groups)
        self.bytes, self.bytes_at = memoryview(data), at[word_at].tolist()

    def groups(self, i: int) -> memoryview:
        """Without the last ";"."""
        return self.bytes[self.bytes_at[i]:max(self.bytes_at[i + 1] - 1, self.bytes_at[i])]

    def fragment(self, i: int) -> Fragment:
        out = Fragment()
        out.cut, out.ok = True, bool(self.ok[i])
        out.n_a, out.n_b, out.n_groups = int(self.n_a[i]), int(self.n_b[i]), int(self.n_groups[i])
        out.groups = [bytes(self.groups(i))] if out.n_groups else []
        out.links = self.links[self.link_at[i]:self.link_at[i + 1]].tolist()
        return out

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct links of each text, how many times it has each, and their offsets by text."""
        n = len(self.link_at) - 1
        span = 1 + int(self.links.max(initial=0))
        keys = np.sort(np.repeat(np.arange(n), np.diff(self.link_at)) * span + self.links)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        keys, times = keys[first], np.diff(np.append(first, len(keys)))
        return keys % span, times.astype(np.int32), np.searchsorted(keys, np.arange(n + 1) * span)


class Aligner:
    """Both tokenizers and the closed fragments of words.

    A worker keeps the words that it met last: ``place`` has a word's row in ``kept``, ``last`` the look-up that
    used the row.
    """

    def __init__(self, spec_a: bytes, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_str(spec_a.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        model = json.loads(spec_a)["model"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        self.plain = self._by_ranks(model)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.width = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        self.space = pieces.index("▁")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.size_b = np.array([len(p) for p in self.bytes_b])
        self.table_a = pa.array([self.bytes_a.get(i, b"") for i in range(len(self.size_a))], type=pa.binary())
        self.table_b = pa.array(self.bytes_b, type=pa.binary())
        self.decimal = pa.array([f"{i}{mark}".encode() for i in range(max(len(self.size_a), self.width)) for mark in ",|;"],
                                type=pa.binary())
        self.place: dict[bytes, int] = {}
        self.kept, self.last, self.lookups = Closed.none(), np.zeros(0, dtype=np.int64), 0

    def _by_ranks(self, model: dict):
        """A's merges by rank for plain Latin text, if its ids are in the sequence of its merges; None otherwise."""
        merges = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        if sorted(self.bytes_a)[:256] != list(range(256)) or any(len(self.bytes_a[i]) != 1 for i in range(256)) \
                or any(vocab[x + y] != 256 + k for k, (x, y) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {t: i for i, t in self.bytes_a.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("plain", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, word: str) -> tuple[Tokens, Tokens, bool]:
        """A's tokens, B's tokens, and whether both give the bytes of a space and the word."""
        ids_a = self.a.encode(" " + word, add_special_tokens=False).ids
        ids_b = self.b.encode(word) or [self.space]  # a lone space: the library adds none before an empty text
        parts_a, parts_b = [self.bytes_a.get(i, b"") for i in ids_a], [self.bytes_b[i] for i in ids_b]
        want = b" " + word.encode()
        return _ends(ids_a, parts_a), _ends(ids_b, parts_b), b"".join(parts_a) == want and b"".join(parts_b) == want

    def known(self, words: pa.Array) -> Closed:
        """The closed fragments of distinct words, each with its space before it."""
        keys = words.to_pylist()
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.place), len(self.place) + len(new))
            self.kept = Closed.concat([self.kept, self._made(words.take(pa.array(new)))])
            self.place.update(zip(map(keys.__getitem__, new.tolist()), at[new].tolist()))
            self.last = np.concatenate([self.last, np.zeros(len(new), dtype=np.int64)])
        self.lookups += 1
        self.last[at] = self.lookups
        out = self.kept.take(at)
        if len(self.place) > 2 * WORDS:
            keep = np.sort(np.argsort(self.last, kind="stable")[-WORDS:])
            names = list(self.place)  # in the order of their rows
            self.place = dict(zip(map(names.__getitem__, keep.tolist()), range(len(keep))))
            self.kept, self.last = self.kept.take(keep), self.last[keep]
        return out

    def _made(self, words: pa.Array) -> Closed:
        alone = np.ones(len(words), dtype=bool)
        parts, rows = [], []
        if self.plain:
            latin = np.flatnonzero(_latin(*_spans(words)))
            for k in range(0, len(latin), TOGETHER):
                some = latin[k:k + TOGETHER]
                if (found := self._made_together(words.take(pa.array(some)))) is not None:
                    parts.append(found)
                    rows.append(some)
                    alone[some] = False
        alone = np.flatnonzero(alone)
        parts.append(self._made_alone([words[i].as_py()[1:].decode() for i in alone.tolist()]))
        return Closed.concat(parts).take(np.argsort(np.concatenate([*rows, alone]), kind="stable"))

    def _made_alone(self, words: list[str]) -> Closed:
        groups, links, counts, ok = [], [], [], []
        for word in words:
            a, b, good = self.tokens(word)
            f = closed_fragment(a, b, self.width) if good else Fragment()
            groups.append(b"".join(g + b";" for g in f.groups))
            links.append(f.links)
            counts.append((f.n_a, f.n_b, f.n_groups))
            ok.append(good)
        return Closed(pa.array(groups, type=pa.binary()), np.array([x for one in links for x in one], dtype=np.int64),
                      _offsets([len(one) for one in links]), np.array(counts, dtype=np.int64).reshape(-1, 3), np.array(ok, dtype=bool))

    def _made_together(self, words: pa.Array) -> Closed | None:
        """The fragments of many words as one text: between them both tokenizers have a token end. None if not so."""
        data, at = _spans(words)
        want = data.tobytes()
        text = want.decode()
        ids_a = np.array(self.plain.encode_ordinary(text), dtype=np.int64)
        ids_b = np.array(self.b.encode(text[1:]), dtype=np.int64)
        if any(_spans(t.take(pa.array(i)))[0].tobytes() != want for t, i in ((self.table_a, ids_a), (self.table_b, ids_b))):
            return None
        ends = np.zeros(len(data) + 1, dtype=np.int8)  # 1 where a token of A ends, 2 where one of B does
        ends[np.cumsum(self.size_a[ids_a])] = 1
        ends[np.cumsum(self.size_b[ids_b])] += 2
        if not (ends[at[1:]] == 3).all():
            return None
        # between neighbouring ends of either kind lies the common part of one token of each: a link
        parts = np.flatnonzero(ends)
        kind = ends[parts]
        is_a, is_b, closes = (kind & 1).astype(bool), kind >= 2, kind == 3
        upto_a, upto_b, upto_groups = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(closes)
        links = ids_a[upto_a - is_a] * self.width + ids_b[upto_b - is_b]
        # a group's A ids, then its B ids: behind the B ids of the groups before, behind the A ids of groups upto its own
        group = upto_groups - closes
        after_a, after_b = upto_a[closes], np.concatenate([[0], upto_b[closes]])
        marked = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        marked[np.arange(len(ids_a)) + after_b[group[is_a]]] = ids_a * 3 + closes[is_a]
        marked[np.arange(len(ids_b)) + after_a[group[is_b]]] = ids_b * 3 + 2 * closes[is_b]
        texts, text_at = _spans(self.decimal.take(pa.array(marked)))
        last = np.searchsorted(parts, at[1:])  # the part that ends each word
        counts = np.stack([upto_a[last], upto_b[last], upto_groups[last]], axis=1)
        groups = _binary(texts, np.concatenate([[0], text_at[counts[:, 0] + counts[:, 1]]]))
        return Closed(groups, links, np.concatenate([[0], last + 1]), np.diff(counts, axis=0, prepend=0),
                      np.ones(len(words), dtype=bool))

    def joined(self, texts: list[bytes]) -> Joined:
        """The composition of each text's words: their closed fragments, joined."""
        raw = b" " + b" ".join(texts)
        text_at = _offsets([len(t) + 1 for t in texts])
        starts = word_starts(np.frombuffer(raw, dtype=np.uint8), text_at[:-1])
        words = _binary(raw, np.concatenate([starts, [len(raw)]])).dictionary_encode()
        known = self.known(words.dictionary)
        return Joined(known.take(words.indices.to_numpy()), np.searchsorted(starts, text_at))

    def range_fragments(self, ranges: list[tuple[bytes, int, int]]) -> list[Fragment]:
        """The fragments of bytes lo..hi of space + text: the words inside, and the tokens that end in the range of
        the words that it cuts (the first before lo, the last after hi)."""
        cut = []
        for text, lo, hi in ranges:
            raw = b" " + text
            at = np.append(word_starts(np.frombuffer(raw, dtype=np.uint8), np.zeros(1, dtype=np.int64)), len(raw))
            first, last = int(lo > 0), len(at) - 1 - int(len(raw) > hi)
            cut.append((raw, at, first, last))
        inside = self.joined([raw[at[first] + 1:at[last]] if last > first else b"" for raw, at, first, last in cut])
        out = []
        for k, ((_, lo, hi), (raw, at, first, last)) in enumerate(zip(ranges, cut)):
            parts = []
            if first:
                parts.append(self._cut_word(raw[1:at[1]].decode(), 0, lo, hi))
            if last > first:
                parts.append(inside.fragment(k))
            if first <= last < len(at) - 1:
                begin = Fragment()
                begin.cut = True  # the word begins in the range, at a common end
                parts.append(compose(begin, self._cut_word(raw[at[last] + 1:].decode(), int(at[last]), lo, hi), self.width))
            total = parts[0]
            for p in parts[1:]:
                total = compose(total, p, self.width)
            out.append(total)
        return out

    def _cut_word(self, word: str, at: int, lo: int, hi: int) -> Fragment:
        a, b, ok = self.tokens(word)
        a, b = ([(i, at + e) for i, e in t if lo < at + e <= hi] for t in (a, b))
        out = fragment_of(a, b, self.width)
        out.ok = ok
        return out


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(files) -> Aligner:
    """The worker's aligner of the broadcast (name, A's file, B's file); tasks that follow each other share its words."""
    name, spec_a, model_b = files.value
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(spec_a, model_b)
    return _ALIGNERS[name]


def _ends(ids: list[int], parts: list[bytes]) -> Tokens:
    out, at = [], 0
    for i, p in zip(ids, parts):
        at += len(p)
        out.append((i, at))
    return out


def word_starts(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of texts with a space before each: there, and at spaces behind a character other
    than white space."""
    at = np.flatnonzero(data == 32)
    before = data[at - 1]
    begins = ~_ASCII_SPACE[before]
    wide = np.flatnonzero(before >= 128)
    ends = [data[np.maximum(at[wide] - k, 0)].astype(np.int64) for k in (1, 2, 3)]
    two = ends[0] | ends[1] << 8
    begins[wide[np.isin(two, _WIDE_SPACE) | np.isin(two | ends[2] << 16, _WIDE_SPACE)]] = False
    begins[np.searchsorted(at, text_at)] = True
    return at[begins]


def _latin(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which words have characters of ``_LATIN`` only and don't end in white space."""
    odd = ~_LATIN[data]
    low = (data[:-1] == 0xC2) & ((data[1:] <= 0xA0) | (data[1:] == 0xAD))
    odd[:-1] |= low | (data[:-1] == 0xC9) & (data[1:] > 0x8F)
    return (np.add.reduceat(odd, at[:-1], dtype=np.int64) == 0) & ~_ASCII_SPACE[data[at[1:] - 1]]


# --- Spark ----------------------------------------------------------------------------

_OPEN = "array<struct<id:int,end:long>>"
FRAGMENT = (f"ok boolean, cut boolean, n_a long, n_b long, n_groups long, groups binary, codes array<long>, times array<int>, "
            f"pa {_OPEN}, pb {_OPEN}, sa {_OPEN}, sb {_OPEN}")
_ARROW_OPEN = pa.list_(pa.struct([("id", pa.int32()), ("end", pa.int64())]))
_ARROW = [pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
_FRAGMENT_NAMES = ["ok", "cut", "n_a", "n_b", "n_groups", "groups", "codes", "times", "pa", "pb", "sa", "sb"]


def _counted(links: list[int]) -> tuple[np.ndarray, np.ndarray]:
    codes, times = np.unique(np.array(links, dtype=np.int64), return_counts=True)
    return codes, times.astype(np.int32)


def _columns(found: list[Fragment]) -> list[pa.Array]:
    open_ = [[[{"id": i, "end": e} for i, e in t] for t in (*f.prefix, *f.suffix)] for f in found]
    counted = [_counted(f.links) for f in found]
    rows = [[f.ok for f in found], [f.cut for f in found], [f.n_a for f in found], [f.n_b for f in found],
            [f.n_groups for f in found], [b";".join(f.groups) for f in found], [c for c, _ in counted], [t for _, t in counted]]
    return [pa.array(r, type=t) for r, t in zip(rows, _ARROW)] + [
        pa.array([o[k] for o in open_], type=_ARROW_OPEN) for k in range(4)]


def _read(row: dict) -> Fragment:
    f = Fragment()
    f.ok, f.cut, f.n_a, f.n_b, f.n_groups = (row[c] for c in ("ok", "cut", "n_a", "n_b", "n_groups"))
    f.groups = [row["groups"]] if f.n_groups else []
    pa_, pb, sa, sb = ([(t["id"], t["end"]) for t in row[c]] for c in ("pa", "pb", "sa", "sb"))
    f.prefix, f.suffix = (pa_, pb), (sa, sb)
    return f


_WHOLE = "id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


_WHOLE_NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]


def _finish(ids: pa.Array, found: list[Fragment | None], codes: list, times: list) -> pa.RecordBatch:
    """Whole texts; None or not ``ok``: no tokens."""
    ok = [f is not None and f.ok and f.n_a > 0 for f in found]
    rows = [[(f.n_a, f.n_b, f.n_groups, int(np.sum(t)), hashlib.sha256(b";".join(f.groups)).hexdigest(), c, t) if good
             else (0, 0, 0, 0, "", [], []) for f, good, c, t in zip(found, ok, codes, times)]]
    cols = list(zip(*rows[0])) or [()] * 7
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), type=t) for c, t in zip(cols, types))], names=_WHOLE_NAMES)


def _whole(files) -> Callable:
    """Texts of one range."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for rows, texts in text_chunks(batches, "text", CHUNK):
            found = aligner.joined(texts)
            ok = found.ok & (np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) > 0)
            codes, times, at = found.counted()
            kept = np.repeat(ok, np.diff(at))  # other texts have no tokens
            lists = _offsets(np.diff(at) * ok)
            numbers = [found.n_a * ok, found.n_b * ok, found.n_groups * ok, np.diff(found.link_at) * ok]
            digests = [hashlib.sha256(found.groups(i)).hexdigest() if good else "" for i, good in enumerate(ok.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), *map(pa.array, numbers), pa.array(digests, type=pa.string()),
                 lists_of(codes[kept], lists), lists_of(times[kept], lists)], names=_WHOLE_NAMES)
    return run


def _cut_ranges(size: int) -> Callable:
    """Rows (row, id, number, lo, hi, text): the words that each byte range touches, and the range within them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(as_bytes(batch.column("text"))):
                raw = b" " + text
                starts = word_starts(np.frombuffer(raw, dtype=np.uint8), np.zeros(1, dtype=np.int64))
                ends = np.append(starts[1:], len(raw))
                out = []
                for number, lo in enumerate(range(0, int(ends[-1]), size)):
                    hi = min(lo + size, int(ends[-1]))
                    a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="left")
                    out.append((number, lo - int(starts[a]), hi - int(starts[a]), int(starts[a]), raw[starts[a] + 1:ends[b - 1]]))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(c).slice(i, 1).to_pylist() * len(out), type=batch.column(c).type) for c in ("row", "id")]
                    + [pa.array(list(c), type=t) for c, t in zip(cols, [pa.int32()] + [pa.int64()] * 3 + [pa.binary()])],
                    names=["row", "id", "number", "lo", "hi", "base", "text"])
    return run


def _range_fragments(files) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for batch, texts in text_chunks(batches, "text", CHUNK):
            lo, hi, base = (batch.column(c).to_pylist() for c in ("lo", "hi", "base"))
            found = aligner.range_fragments(list(zip(texts, lo, hi)))
            for f, b in zip(found, base):
                f.prefix, f.suffix = (tuple([(i, b + e) for i, e in t] for t in side) for side in (f.prefix, f.suffix))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "number")), *_columns(found)],
                                             names=["row", "id", "number", *_FRAGMENT_NAMES])
    return run


def _composed(width: int) -> Callable:
    """Neighbours of a group as one row."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["codes", "times"]).to_pylist(), key=lambda r: r["number"])
        total = None
        for r in rows:
            f = _read(r)
            total = f if total is None else compose(total, f, width)
        extra = _counted(total.links)  # of the groups that closed here
        codes, times = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("codes", "times"))
        codes, at = np.unique(np.concatenate([codes, extra[0]]), return_inverse=True)
        summed = np.bincount(at, np.concatenate([times, extra[1]]), len(codes)).astype(np.int32)
        total.links = []
        columns = _columns([total])
        columns[6], columns[7] = pa.array([codes], type=_ARROW[6]), pa.array([summed], type=_ARROW[7])
        head = [pa.array([rows[0][c]], type=table.column(c).type) for c in ("row", "id")]
        return pa.Table.from_arrays([*head, pa.array([rows[0]["number"] // FAN], type=pa.int32()), *columns],
                                    names=["row", "id", "number", *_FRAGMENT_NAMES])
    return run


def _finished(width: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, codes, times = [], [], []
            for i, r in enumerate(batch.drop_columns(["codes", "times"]).to_pylist()):
                # the text begins and ends at a common end: what is open at its ends are groups
                whole = Fragment()
                whole.cut = True
                whole = compose(compose(whole, _read(r), width), whole, width)
                extra = _counted(whole.links)
                found.append(whole)
                codes.append(np.concatenate([batch.column("codes")[i].values.to_numpy(), extra[0]]))
                times.append(np.concatenate([batch.column("times")[i].values.to_numpy(), extra[1]]))
            yield _finish(batch.column("id"), found, codes, times)
    return run


def _long_texts(texts: DataFrame, files, width: int, size: int, kind: str) -> DataFrame:
    """Texts of several ranges: one task per few ranges, then the tree."""
    n_ranges, longest = texts.agg(F.sum(1 + F.floor(F.octet_length("text") / size)), F.max(F.octet_length("text"))).first()
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    ranges = (numbered.mapInArrow(_cut_ranges(size), f"row long, id {kind}, number int, lo long, hi long, base long, text binary")
              .repartition("row", "number"))
    schema = f"row long, id {kind}, number int, {FRAGMENT}"
    found = ranges.mapInArrow(_range_fragments(files), schema)
    last = (longest or 0) // size  # number of the longest text's last range
    while last > 0:
        found = found.groupBy("row", F.floor(F.col("number") / FAN).alias("group")).applyInArrow(_composed(width), schema)
        last //= FAN
    return store(found, "fragments", n_ranges or 0, TEXT_ROWS).mapInArrow(_finished(width), _WHOLE.format(id=kind))


def align(docs: DataFrame, tokenizer_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text",
          size: int = RANGE) -> DataFrame:
    """row (a number), id, n_a, n_b, n_groups, n_links, groups_sha256, codes and times: a text's distinct linked pairs
    (A's id times B's vocabulary size plus B's id) and how many links hold each; stored.

    The tree runs when called.
    """
    spark = prepare(docs.sparkSession)
    specs = file_bytes(tokenizer_a), file_bytes(model_b)
    files = spark.sparkContext.broadcast((hashlib.sha256(b"".join(specs)).hexdigest(), *specs))
    width = vocabulary_size(model_b)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.octet_length("text") >= size, F.lit(False))
    short = texts.filter(~is_long).mapInArrow(_whole(files), _WHOLE.format(id=kind))
    whole = short.union(_long_texts(texts.filter(is_long), files, width, size, kind))
    return store(whole.withColumn("row", F.monotonically_increasing_id()), "aligned", docs.count(), TASK_ROWS)


def vocabulary_size(model_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=file_bytes(model_b)).vocab_size()


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """code, corpus (links of the corpus that hold the pair), best (the most of its B id); stored."""
    pairs = aligned.select(F.explode(F.arrays_zip("codes", "times")).alias("p"))
    counts = pairs.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("corpus"))
    counts = counts.withColumn("b", F.col("code") % width)
    most = counts.groupBy("b").agg(F.max("corpus").alias("most"))
    return store(counts.join(most, "b").select("code", "corpus", (F.col("corpus") == F.col("most")).alias("best")), "pairs",
                 aligned.count(), TASK_ROWS)


def digests(docs: DataFrame, tokenizer_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text",
            size: int = RANGE, slice_pairs: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align(docs, tokenizer_a, model_b, id_col, text_col, size)
    counts = pair_counts(aligned, vocabulary_size(model_b))
    n_slices, n_texts = 1 + counts.count() // slice_pairs, aligned.count()
    pairs = aligned.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select(
        "row", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    sums = None
    for k in range(n_slices):
        part = F.broadcast(counts.filter(F.pmod(F.xxhash64("code"), F.lit(n_slices)) == k))
        of = (pairs.join(part, "code").groupBy("row")
              .agg(F.sum(F.col("times") * F.col("corpus")).alias("count_sum"),
                   F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")))
        if n_slices > 1:
            of = store(of, "sums", n_texts, TASK_ROWS)
        sums = of if sums is None else sums.union(of)
    if n_slices > 1:
        sums = sums.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    none = F.lit(0).cast("long")
    return in_tasks(aligned.drop("codes", "times").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"), n_texts)
