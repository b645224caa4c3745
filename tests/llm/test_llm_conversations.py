"""Prefix trie, token alignment and chat formatting against plain Python versions."""

import cProfile
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brute import SMALL, SPACED, hard_docs, hard_texts, ordered, rows_of
from tokenizers import Tokenizer

from disputelens.llm import chat_format, prefix_trie, token_align
from disputelens.llm.ordered import digest_in_order, in_ranges

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
CONV_SCHEMA = "conv_id long, turn long, role string, text string, k1 long, depth string, part int, digest string, n_convs long"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def conv_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, "clash", 3) for r in rows], CONV_SCHEMA).repartition(4)


def by_turn(rows):
    """conv_id -> [(role, text)] in the operators' order."""
    key = lambda r: (r[1] is not None, r[1] or 0, sha(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}"))
    out = defaultdict(list)
    for r in sorted(rows, key=key):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def random_conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 1, 2, 3, 5, 9, 12])):
            rows.append((c * r.choice([1, 1, 3]), t, r.choice(["user", "assistant", None]), r.choice(["a", "b c", "", None, "x y z"])))
    return rows


HARD = [
    *[(40, t, "user", f"t {t}") for t in range(40)],  # a donor deeper than several bands
    *[(c, t, "user", f"t {t}" if t < 25 else f"c {c}") for c in (41, 42, 43, 44, 45, 46) for t in range(38)],
    (61, None, None, None), (61, None, None, None), (61, 0, "user", "x"), (61, 0, "user", "x"), (61, 0, "assistant", "x"),
    (80, 0, "user", "only"), (81, 0, "user", "own"), (82, 5, "user", "own"), (83, -3, "system", "own"),
    (-1, 0, "user", "neg"), (-20, 0, "user", "neg"), (-21, 0, "user", "neg"), (0, 0, "user", "z " * 3000),
    (None, 0, "user", "nobody"), (2**62, 0, "user", "big"),
]


# --- op11 ---------------------------------------------------------------------------

OP11 = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows):
    turns = by_turn([r for r in rows if r[0] is not None])
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(SPACED.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    return ordered([(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node],
                     saved[node], sha(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(node))))
                    for node, m in members.items()])


@pytest.mark.parametrize("band,segment", [(8, 1024), (2, 4), (3, 6)])
def test_trie_hard_cases(spark, monkeypatch, band, segment):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    assert rows_of(prefix_trie.shared_prefixes(conv_frame(spark, HARD)), *OP11) == trie(HARD)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_random(spark, seed):
    rows = random_conversations(seed)
    assert rows_of(prefix_trie.shared_prefixes(conv_frame(spark, rows)), *OP11) == trie(rows)


def test_trie_turnless_and_empty(spark):
    rows = [(1, 0, "user", "a"), (3, 0, "user", "b")]  # their donor 0 is absent
    got = rows_of(prefix_trie.shared_prefixes(conv_frame(spark, rows)), *OP11)
    assert got == trie(rows)
    alone = [(c, 0, "user", "a") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = rows_of(prefix_trie.shared_prefixes(conv_frame(spark, alone)), *OP11)
    assert got == trie(alone) and len(got) == 1 and got[0][3:6] == (len(alone), 0, 1)
    assert prefix_trie.shared_prefixes(conv_frame(spark, []).limit(0)).count() == 0


def test_a_node_is_exploded_within_its_band_only(spark, monkeypatch):
    """One conversation of 300 turns: no round makes more than BAND rows of a node."""
    made = []
    climb = prefix_trie._climb

    def counted(values):
        made.append((values.count(), values.selectExpr("sum(size(path))").first()[0], values.selectExpr("max(size(path))").first()[0]))
        return climb(values)

    monkeypatch.setattr(prefix_trie, "_climb", counted)
    rows = [(0, t, "user", f"t{t}") for t in range(300)]
    assert rows_of(prefix_trie.shared_prefixes(conv_frame(spark, rows)), *OP11) == trie(rows)
    assert max(m[2] for m in made) == prefix_trie.BAND
    assert len(made) == 5  # three levels (300, 38, 5), two of them handed down


def test_digest_in_order_streams_pieces(spark):
    rows = [(k, i, f"{k}:{i};".encode(), 1) for k in (None, 1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i int, data binary, n long").repartition(7)
    got = rows_of(digest_in_order(df, ["k"], ["i"], ["data"], ["n"], b"|"), "k", "data", "n")
    assert got == ordered([(k, sha("|".join(f"{k}:{i};" for i in range(500))), 500) for k in (None, 1, 2)])


def test_ranges_split_equal_rows(spark):
    df = spark.range(4000).selectExpr("1 AS k", "id % 2 AS t")
    parts = in_ranges(df.repartition(8), "k", "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = parts.groupBy("part").agg({"t": "min", "*": "count"}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) >= 6 and max(r["count(1)"] for r in found) < 1500


# --- op12 ---------------------------------------------------------------------------

OP12 = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
MIXED = [(100, "  two  leading and trailing  ", "x"), (101, "a▁b", "x"), (102, "ﬁ ① 😀😀 tab\tx  y　 z\n\n  new", "x"), (103, " ", "x"),
         (104, "<s></s> <|endoftext|> <unk> <0x41>", "x"), (105, "x\x1c y\x85 z", "x"), (106, "ア" * 400, "x"),
         (107, "supercalifragilistic" * 60, "x"), (108, "don't we'll 'S 123456 ==== ", "x")]


def links_of(text):
    """None, or (A ids, B ids, groups text, links) of a text, straight from the libraries."""
    tok, sp = links_of.tok, links_of.sp
    if not text:
        return None
    want = (" " + text).encode()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    piece = lambda i: sp.id_to_piece(i)
    symbols = {c: v for v, c in enumerate(token_align.byte_symbols())}
    ab = [bytes(symbols[c] for c in tok.id_to_token(i)) for i in a]
    bb = [bytes([int(piece(i)[3:5], 16)]) if re.fullmatch("<0x..>", piece(i)) else piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(ab) != want or b"".join(bb) != want:
        return None
    spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[:k + 1]))) for k in range(len(parts))]
    sa, sb = spans(ab), spans(bb)
    links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
    groups, start = [], 0
    for end in sorted({e for _, e in sa} & {e for _, e in sb}):
        groups.append(",".join(str(i) for i, s in zip(a, sa) if start < s[1] <= end) + "|"
                      + ",".join(str(i) for i, s in zip(b, sb) if start < s[1] <= end))
        start = end
    return a, b, ";".join(groups), links


links_of.tok = Tokenizer.from_file(BYTE_BPE)
links_of.tok.encode_special_tokens = True
links_of.sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def aligned(docs):
    found = [(i, links_of(t)) for i, t, _ in docs]
    count = Counter(x for _, f in found if f for x in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return ordered([(i, len(f[0]), len(f[1]), f[2].count(";") + 1, len(f[3]), sum(count[x] == most[x[1]] for x in f[3]),
                     sum(count[x] for x in f[3]), sha(f[2])) if f else (i, 0, 0, 0, 0, 0, 0, "") for i, f in found])


def align_docs():
    return [(i, t if t is None or len(t) < 20_000 else t[:3000], lang) for i, t, lang in hard_texts()] + MIXED


@pytest.mark.parametrize("size,slice_pairs", [(token_align.RANGE, token_align.SLICE), (16, 50), (7, 10**6), (61, 10**6)])
def test_alignment_hard_cases(spark, monkeypatch, size, slice_pairs):
    """Also with ranges so small that they cut words and groups, deep trees, and several slices."""
    monkeypatch.setattr(token_align, "FAN", 3)
    docs = align_docs()
    got = rows_of(token_align.digests(hard_docs(spark, docs), BYTE_BPE, PIECE_BPE, size=size, slice_pairs=slice_pairs), *OP12)
    assert got == aligned(docs)
    assert token_align.digests(hard_docs(spark, docs).limit(0), BYTE_BPE, PIECE_BPE).count() == 0


def test_fragments_compose_in_any_bracketing():
    r = random.Random(4)
    for _ in range(300):
        ends = lambda: sorted(r.sample(range(1, 40), r.randint(1, 12))) + [40]
        a, b = [(r.randint(0, 9), e) for e in ends()], [(r.randint(0, 9), e) for e in ends()]
        cuts = sorted({0, 40, *r.sample(range(1, 40), r.randint(0, 9))})
        parts = [token_align.fragment_of([t for t in a if lo < t[1] <= hi], [t for t in b if lo < t[1] <= hi], 10)
                 for lo, hi in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k:k + 2] = [token_align.compose(parts[k], parts[k + 1], 10)]
        want = token_align.fragment_of(a, b, 10)
        got = parts[0]
        assert (got.cut, got.prefix, got.suffix, got.n_a, got.n_b, got.n_groups) == (
            want.cut, want.prefix, want.suffix, want.n_a, want.n_b, want.n_groups)
        assert (b";".join(got.groups), got.links) == (b";".join(want.groups), want.links)


WHITE = "  aab é1.'\t\n\r\x0b\x1c\x1f\x85\xa0\xad\xa1ɏɐ\u1680\u2002\u2028\u202f\u205f\u3000\u200bア😀àĀ"


class _Files:
    value = ("test", open(BYTE_BPE, "rb").read(), open(PIECE_BPE, "rb").read())


def whole_rows(texts):
    batch = pa.record_batch({"id": list(range(len(texts))), "text": pa.array(texts, type=pa.string())})
    return [r for b in token_align._whole(_Files)([batch]) for r in b.to_pylist()]


def test_alignment_takes_no_python_step_per_word():
    """Python calls for new words, in their number (6 and more of each before); the rest is done on arrays."""
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(4, 9))) for _ in range(100)) for _ in range(300)]
    token_align._ALIGNERS.clear()
    whole_rows(["x"])
    with cProfile.Profile() as profile:
        got = whole_rows(texts)
    assert sum(e.callcount for e in profile.getstats()) < len({w for t in texts for w in t.split()}) < 30_000
    for k in (0, 150, 299):
        a, b, groups, links = links_of(texts[k])
        assert (got[k]["n_a"], got[k]["n_b"], got[k]["n_links"], got[k]["groups_sha256"]) == (len(a), len(b), len(links), sha(groups))


def test_words_begin_at_spaces_behind_other_than_white_space():
    r = random.Random(9)
    for _ in range(300):
        texts = ["".join(r.choice(WHITE) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
        raw = " " + " ".join(texts)
        data = np.frombuffer(raw.encode(), dtype=np.uint8)
        at = np.append(token_align.word_starts(data, token_align._offsets([len(t.encode()) + 1 for t in texts])[:-1]), len(data))
        words = [w for t in texts for w in re.split(r"(?<=\S) ", t)]
        assert [data[x:y].tobytes().decode() for x, y in zip(at, at[1:])] == [" " + w for w in words]
        plain = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]*[\x21-\x7e\xa1-\xac\xae-\u024f]")
        assert token_align._latin(data, at).tolist() == [bool(plain.fullmatch(w)) for w in words]


def test_alignment_with_few_words_kept(monkeypatch):
    """Words leave the worker and come back; chunks of few texts."""
    monkeypatch.setattr(token_align, "WORDS", 40)
    monkeypatch.setattr(token_align, "CHUNK", 200)
    token_align._ALIGNERS.clear()
    r = random.Random(10)
    texts = [None, "", " "] + ["".join(r.choice(WHITE) for _ in range(r.randint(1, 60))) for _ in range(300)]
    got = whole_rows(texts)
    aligner = token_align._ALIGNERS["test"]
    assert len(aligner.place) == len(aligner.last) == len(aligner.kept.ok) <= 80
    token_align._ALIGNERS.clear()
    for x, t in zip(got, texts, strict=True):
        f = links_of(t)
        want = Counter(a * 32000 + b for a, b in f[3]) if f else {}
        assert (x["n_a"], x["n_b"], x["n_links"], x["groups_sha256"]) == ((len(f[0]), len(f[1]), len(f[3]), sha(f[2])) if f else (0, 0, 0, ""))
        assert dict(zip(x["codes"], x["times"], strict=True)) == want


def test_alignment_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    from disputelens.llm.queries import queries

    got = rows_of(queries()["op12_token_align"](spark, SMALL), *OP12)
    fast = [(i, t, None) for i, t, _ in docs if not t or len(t) < 1500]
    rows = {r[0]: r for r in got}
    assert len(got) == len(docs)
    for i, t, _ in fast:
        f = links_of(t)
        assert rows[i][1:5] + rows[i][7:] == ((len(f[0]), len(f[1]), f[2].count(";") + 1, len(f[3]), sha(f[2])) if f else (0,) * 4 + ("",))


# --- op13 ---------------------------------------------------------------------------

OP13 = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
CONTROLS = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST] \\", "<s", "s>", "<|endoftext|> <s><s>", "[/INST][INST", "\n lead", "trail \n",
            "", None, "😀é́ ア", "<", "\\s>", "[INST]" * 5, "  "]


def formatted(rows):
    rows = [*rows, *[(-1, t, r, chat_format.CONTROL_TEXT) for t, r in enumerate(["user", "assistant"])]]
    out = []
    for c, turns in by_turn(rows).items():
        lost = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), sha(lost)))
    return ordered(out)


@pytest.mark.parametrize("piece", [chat_format.PIECE, 30])
def test_chat_format_hard_cases(spark, monkeypatch, piece):
    monkeypatch.setattr(chat_format, "PIECE", piece)
    r = random.Random(7)
    rows = [(c, t if c % 3 else None, r.choice(["user", "assistant", "system", None, "<s>", "a[/INST]"]), r.choice(CONTROLS))
            for c in range(40) for t in range(r.randint(1, 9))]
    rows += HARD
    rows += [(200 + i, t, role, x) for i, x in enumerate(CONTROLS) for t, role in enumerate(["user", "assistant", "assistant"])]
    got = chat_format.digests(conv_frame(spark, rows), BYTE_BPE)
    assert rows_of(got, *OP13) == formatted(rows)
    assert got.filter("formatted_chars < loss_chars").count() == 0
    only = chat_format.digests(conv_frame(spark, []).limit(0), BYTE_BPE)
    assert rows_of(only, *OP13) == formatted([])


def test_tokens_are_those_of_the_whole_conversation(spark):
    """Pieces' ids, one after the other, are the library's for the whole text, and no control string is left in texts."""
    rows = [(1, t, "assistant" if t % 2 else "user", CONTROLS[t] or "n") for t in range(len(CONTROLS)) if "endoftext" not in (CONTROLS[t] or "")]
    out = chat_format.format_conversations(conv_frame(spark, rows), BYTE_BPE).orderBy("part", "piece").collect()
    text = "".join(r.text for r in out)
    tok = Tokenizer.from_file(BYTE_BPE)
    tok.add_special_tokens(list(chat_format.MARKS))
    whole = tok.encode(text, add_special_tokens=False)
    assert [i for r in out for i in r.ids] == whole.ids
    assert [text.count(m) for m in ("<s>", "</s>")] == [len(rows)] * 2
    lost = "".join(text[s:e] for m, (s, e) in zip(b"".join(bytes(r.mask) for r in out), whole.offsets) if m)
    assert chat_format.unescape(lost).count("ok") >= 0 and all(len(r.ids) == len(r.mask) for r in out)


def test_escape_is_reversible(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["<", "[", "\\", "/", "s>", "INST]", "x"]) for _ in range(r.randint(0, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped("t").alias("e")).collect()
    for row in rows:
        assert not any(m in row.e for m in chat_format.MARKS)
        assert chat_format.unescape(row.e) == row.t
