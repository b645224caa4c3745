r"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<s>`` role ``[INST]`` text ``</s>``, or with ``[/INST]`` before a
text that is learned. Control strings inside roles and texts are escaped: a backslash goes
after their first character (``<\s>``, ``[\INST]``), one more where backslashes are there
already, so the escape can be undone and no control string is left.

A conversation is rendered whole and encoded once. The four marks are special tokens of
the encoder, so no token crosses a mark, and the characters of each learned text are
those of a run of tokens. The encoder returns the tokens' character offsets; both they and
the learned spans are sorted, so a binary search for each span's ends gives its run, and the
loss mask is 1 there.

Conversations may be of any size: rows are dealt in ranges of (conv_id, turn), and a
conversation that crosses a range, or that is longer than ``PIECE`` characters, is encoded
in pieces cut between turns. As the marks are cuts for the encoder too, the pieces'
tokens, one after the other, are those of the whole. Only a single turn is held whole.

``read_back`` takes the written pieces: turns from the text by the template, learned texts
from the token ids under the mask. Null role or text is empty, a null turn comes first,
rows of one turn number are taken by the SHA-256 of role and text, and rows with a null
conv_id are one conversation. Repeated rows are turns of their own, other columns are
ignored, and an empty table gives no row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputelens.llm.common import file_bytes, prepare, store
from disputelens.llm.ordered import digest_in_order, in_ranges
from disputelens.llm.prefix_trie import turn_digest

TURN, GIVEN, LEARNED, END = MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
#: Roles whose texts are learned.
LEARNED_ROLES = ("assistant",)
#: Characters after which a piece ends at the next turn.
PIECE = 1 << 20
#: Characters of pieces that are encoded at a time.
BATCH_CHARS = 2 << 20

_INSIDE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"([<\[]\\*)\\(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)\[(/?)INST\](.*?)</s>", re.DOTALL)

FORMATTED = "conv_id {id}, part int, piece int, text string, ids array<int>, mask binary"


def escaped(text: str | Column) -> Column:
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.regexp_replace(text, _INSIDE, r"$1$2\\$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


# --- encoding ---------------------------------------------------------------------

def _encoder(spec: bytes):
    """The tokenizer of a file's bytes, with the marks as special tokens after its own ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec.decode())
    tok.no_truncation()
    tok.no_padding()
    own = [t["content"] for t in json.loads(spec)["added_tokens"]]
    tok.add_special_tokens(list(MARKS))
    return tok, own


class Piece:
    """Turns of one conversation, rendered, with the character spans of learned texts."""

    def __init__(self, conv_id, part: int, number: int):
        self.at, self.text, self.size, self.spans = (conv_id, part, number), [], 0, []

    def add(self, role: str, text: str, learned: bool) -> None:
        head = TURN + role + (LEARNED if learned else GIVEN)
        if learned:
            self.spans += [self.size + len(head), self.size + len(head) + len(text)]
        self.text += [head, text, END]
        self.size += len(head) + len(text) + len(END)


def loss_mask(offsets: np.ndarray, spans: list[int]) -> np.ndarray:
    """1 for the tokens (rows of start, end) that lie in a span; ``spans`` is start, end, start, end, … ascending."""
    mask = np.zeros(len(offsets), dtype=np.uint8)
    if len(offsets) and spans:
        for first, last in np.searchsorted(offsets[:, 0], spans, side="left").reshape(-1, 2).tolist():
            mask[first:last] = 1
    return mask


def _formatter(spec) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, own = _encoder(spec.value)
        hide = re.compile("|".join(map(re.escape, own))) if own else None
        piece, ready, size, kind = None, [], 0, None

        def encode() -> pa.RecordBatch:
            texts = ["".join(p.text) for p in ready]
            found = [encode_parts(tok, hide, t) for t in texts]
            at = list(zip(*(p.at for p in ready))) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(at[0]), type=kind), pa.array(list(at[1]), type=pa.int32()),
                 pa.array(list(at[2]), type=pa.int32()), pa.array(texts, type=pa.string()),
                 pa.array([i for i, _ in found], type=pa.list_(pa.int32())),
                 pa.array([loss_mask(o, p.spans).tobytes() for (_, o), p in zip(found, ready)], type=pa.binary())],
                names=["conv_id", "part", "piece", "text", "ids", "mask"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, part, role, text, learned in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or piece.at[:2] != (conv, part) or piece.size > PIECE:
                    number = 0
                    if piece is not None:
                        number = piece.at[2] + 1 if piece.at[:2] == (conv, part) else 0
                        ready.append(piece)
                        size += piece.size
                    piece = Piece(conv, part, number)
                piece.add(role, text, learned)
                if size > BATCH_CHARS:
                    yield encode()
                    ready, size = [], 0
        if piece is not None:
            ready.append(piece)
            yield encode()
    return run


def encode_parts(tok, hide: re.Pattern | None, text: str) -> tuple[list[int], np.ndarray]:
    """Ids and character offsets. Special tokens of the vocabulary's own are plain text inside a conversation:
    they are encoded apart, by an encoder that knows no special token."""
    if hide is None or not hide.search(text):
        e = tok.encode(text, add_special_tokens=False)
        return e.ids, np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    ids, offsets, at = [], [], 0
    marks = {m: tok.token_to_id(m) for m in MARKS}
    tok.encode_special_tokens = True
    try:
        for part in re.split("(" + "|".join(map(re.escape, MARKS)) + ")", text):
            if part in marks:
                ids.append(marks[part])
                offsets.append(np.array([[at, at + len(part)]]))
            elif part:
                e = tok.encode(part, add_special_tokens=False)
                ids += e.ids
                offsets.append(np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at)
            at += len(part)
    finally:
        tok.encode_special_tokens = False
    return ids, np.concatenate(offsets)


def format_conversations(conversations: DataFrame, tokenizer: str, learned: tuple[str, ...] = LEARNED_ROLES) -> DataFrame:
    """conv_id, part, piece (their order), text, ids, mask (a byte per token, 1: loss is taken).

    ``conversations``: conv_id, turn, role, text; ``tokenizer``: the path of a byte-level
    tokenizer file.
    """
    spark = prepare(conversations.sparkSession)
    spec = spark.sparkContext.broadcast(file_bytes(tokenizer))
    rows = conversations.select(
        "conv_id", "turn", turn_digest().alias("digest"), escaped("role").alias("role"), escaped("text").alias("text"),
        F.coalesce(F.col("role").cast("string").isin(*learned), F.lit(False)).alias("learned"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return (in_ranges(rows, "conv_id", "turn", "digest").select("conv_id", "part", "role", "text", "learned")
            .mapInArrow(_formatter(spec), FORMATTED.format(id=kind)))


# --- reading back -------------------------------------------------------------------

def token_bytes(spec: bytes) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary (the byte alphabet is the vocabulary's fixed convention)."""
    from disputelens.llm.bpe import byte_symbols

    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    vocab = json.loads(spec)["model"]["vocab"]
    return {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}


def _reader(spec) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(spec.value)
        for batch in batches:
            out = []
            for conv, part, piece, text, ids, mask in zip(*(c.to_pylist() for c in batch.columns)):
                turns = [(unescape(r), unescape(t)) for r, _, t in _TURN.findall(text)]
                flags = np.frombuffer(mask, dtype=np.uint8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
                # a run of masked tokens is one text: marks lie between
                lost = [unescape(b"".join(table[i] for i in ids[a:b]).decode())
                        for a, b in edges.reshape(-1, 2).tolist()]
                out.append((conv, part, piece, "".join(f"{r}\n{t}\n" for r, t in turns).encode(), "".join(lost).encode(),
                            len(turns), sum(map(len, lost)), len(text)))
            cols = list(zip(*out)) or [()] * 8
            types = [batch.column("conv_id").type, pa.int32(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, types)], names=[
                "conv_id", "part", "piece", "turns_sha256", "loss_sha256", "n_turns", "loss_chars", "formatted_chars"])
    return run


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turns_sha256, loss_sha256, n_turns, loss_chars, formatted_chars from the pieces."""
    spec = formatted.sparkSession.sparkContext.broadcast(file_bytes(tokenizer))
    kind = formatted.schema["conv_id"].dataType.simpleString()
    read = formatted.select("conv_id", "part", "piece", "text", "ids", "mask").mapInArrow(
        _reader(spec), f"conv_id {kind}, part int, piece int, turns_sha256 binary, loss_sha256 binary, "
                       "n_turns long, loss_chars long, formatted_chars long")
    return digest_in_order(read, ["conv_id"], ["part", "piece"], ["turns_sha256", "loss_sha256"],
                           ["n_turns", "loss_chars", "formatted_chars"])


#: Two turns that say control strings of the template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def with_control_case(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1: a user and an assistant row that both say ``CONTROL_TEXT``."""
    columns = ["conv_id", "turn", "role", "text"]
    case = conversations.sparkSession.range(2).select(
        F.lit(-1).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return conversations.select(*columns).union(case)


def digests(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Format, write, and read back."""
    formatted = store(format_conversations(with_control_case(conversations), tokenizer), "formatted")
    return read_back(formatted, tokenizer)
