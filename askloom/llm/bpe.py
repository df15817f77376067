"""BPE encoding and decoding with a public byte-level vocabulary.

A long text is cut into pieces that tasks encode side by side. The pieces are joined as a
tree: each join encodes anew a window around the cut, growing it until its tokens agree
with those on both sides, so that the result is what encoding the whole would have given.
Agreement is exact, not likely; ``_joined`` says why. Short texts are one piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .memory import lean

PIECE_CHARS = 16_384  # longer texts are cut
WINDOW_CHARS = 64  # on either side of a join at first; doubled until both sides agree
BATCH_ROWS = 512  # texts in Python at once

# Fixed value: the split before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A match that ends this far before the end of what was seen is final: the longest
#: alternative that looks ahead, a contraction, sees three characters from its start.
LOOKAHEAD = 3


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Ranks of byte strings and the texts of special tokens, from a tokenizer file.

    Only byte-level BPE without a prefix space, normaliser or post-processor is read.
    """

    ranks: dict[bytes, int]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, pre = data["model"], data["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        if not plain or data["normalizer"] or data["post_processor"] or model.get("dropout"):
            raise ValueError("Only plain byte-level BPE files can be read.")
        of = _byte_of_symbol()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(of[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
        return cls(ranks, special)


class Codec:
    """Encodes and decodes single texts; made once per task."""

    def __init__(self, path: str) -> None:
        import tiktoken

        vocabulary = Vocabulary.load(path)
        self.special = vocabulary.special
        self.engine = tiktoken.Encoding(
            "bytes", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens=self.special
        )
        self.bytes_of = {n: b for b, n in vocabulary.ranks.items()} | {
            n: t.encode() for t, n in self.special.items()
        }
        self.digits = [str(n).encode() for n in range(max(self.bytes_of) + 1)]
        self.packed = np.dtype("<u2" if max(self.bytes_of) < 1 << 16 else "<u4")  # a token on its way between tasks
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None

    def encode(self, text: str) -> np.ndarray:
        """All tokens of a text in which the strings of special tokens count as such."""
        return self.engine.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def encode_plain(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def decode(self, ids: list[int]) -> str:
        """The text of the tokens, special ones too; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")

    def sections(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens, across which no token and no match reaches."""
        if self.cut is None:
            return [(text, False)]
        found, at = [], 0
        for m in self.cut.finditer(text):
            found += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [x for x in [*found, (text[at:], False)] if x[0]]

    def raw(self, word: bytes) -> list[int]:
        """Tokens of bytes that the pattern does not split."""
        return self.engine._encode_single_piece(word)

    def word_ends(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]


# -- Tree concatenation ---------------------------------------------------------------


@dataclass
class Node:
    """A stretch of text and the tokens it has on its own."""

    text: str
    ids: list[int]


#: Between another character and white space every match ends: no alternative goes on.
_CERTAIN = regex.compile(r"(?<=\S)\s")


def _last_certain(text: str) -> int:
    """Where the last match certainly ends before white space, else 0."""
    size = 64
    while True:
        begin = max(0, len(text) - size)
        found = [m.start() for m in _CERTAIN.finditer(text, begin)]
        if found or begin == 0:
            return found[-1] if found else 0
        size *= 4


def _first_certain(text: str) -> int:
    found = _CERTAIN.search(text)
    return found.start() if found else len(text)


def _tokens_for(codec: Codec, ids: list[int], size: int, from_end: bool = False) -> int:
    """How many tokens at one end of ``ids`` have ``size`` bytes together."""
    taken = n = 0
    while taken < size:
        taken += len(codec.bytes_of[ids[-1 - n if from_end else n]])
        n += 1
    if taken != size:
        raise ValueError("The tokens do not end where a word ends.")
    return n


def _joined(codec: Codec, left: Node, right: Node, window: int) -> Node:
    """The tokens of two neighbouring stretches as one.

    Only the left side's tail, from its last certain word end on, and the right side's
    head, up to its first, can change. Words are matched from left to right, and a match
    depends only on where it starts, on its characters and on ``LOOKAHEAD`` characters. So
    the tail's words that end that far before the cut are final, and the window starts
    where the last of them ends. The window's own words are final likewise, but for the last
    few. As soon as a final one ends where a word of the head ends, both go on alike from
    there: the sides agree. Until then the window is doubled, at most to the end of the head.

    Only the words in between get new tokens. One that reaches far over the cut is not
    encoded anew but joined from its two parts, by a window of tokens.
    """
    tail, head = left.text[_last_certain(left.text) :], right.text[: _first_certain(right.text)]
    n_tail = _tokens_for(codec, left.ids, len(tail.encode()), from_end=True)
    n_head = _tokens_for(codec, right.ids, len(head.encode()))
    tail_ids, head_ids = left.ids[len(left.ids) - n_tail :], right.ids[:n_head]
    tail_ends, head_ends = codec.word_ends(tail), codec.word_ends(head)
    cut = len(tail)
    start = max([0, *(e for e in tail_ends if e <= cut - LOOKAHEAD)])
    base, size, known = cut - start, window, set(head_ends)
    while True:
        stop = min(size, len(head))
        seen = tail[start:] + head[:stop]
        ends = codec.word_ends(seen)
        final = len(seen) if stop == len(head) else len(seen) - LOOKAHEAD
        meet = next((n for n, e in enumerate(ends) if base < e <= final and e - base in known), None)
        if meet is not None:
            break
        size *= 2
    head_end = ends[meet] - base
    middle, previous = [], 0
    for end in ends[: meet + 1]:
        word = seen[previous:end]
        last_word = tail_ends[-2] if len(tail_ends) > 1 else 0
        if previous < base < end and len(word) > 2 * window and start + previous == last_word and end - base == head_ends[0]:
            n_first = _tokens_for(codec, tail_ids, len(tail[last_word:].encode()), from_end=True)
            n_second = _tokens_for(codec, head_ids, len(head[:head_end].encode()))
            middle += _word_joined(codec, tail_ids[len(tail_ids) - n_first :], head_ids[:n_second])
        else:
            middle += codec.raw(word.encode())
        previous = end
    kept = _tokens_for(codec, tail_ids, len(tail[:start].encode()))
    gone = _tokens_for(codec, head_ids, len(head[:head_end].encode()))
    ids = left.ids[: len(left.ids) - n_tail + kept] + middle + right.ids[gone:]
    return Node(left.text + right.text, ids)


def _word_joined(codec: Codec, first: list[int], second: list[int]) -> list[int]:
    """Tokens of one long word from those of its two parts.

    Byte-pair tokens are the right ones exactly if every two neighbours are the tokens of
    their own text. Inside either part they are. A window of tokens around the cut is
    encoded anew; if it begins and ends with the tokens it began and ended with, all
    neighbours are right. Otherwise the window is doubled, at most to the whole word.
    """
    size = 8
    while True:
        a, b = first[-size:], second[:size]
        made = codec.raw(b"".join(codec.bytes_of[i] for i in [*a, *b]))
        left_fits = len(a) == len(first) or (len(made) > 1 and made[0] == a[0])
        right_fits = len(b) == len(second) or (len(made) > 1 and made[-1] == b[-1])
        if left_fits and right_fits:
            return first[: len(first) - len(a)] + made + second[len(b) :]
        size *= 2


def tree_joined(codec: Codec, nodes: list[Node], window: int = WINDOW_CHARS) -> Node:
    """Neighbours are joined in pairs, then the pairs, up to one node."""
    while len(nodes) > 1:
        pairs = [_joined(codec, a, b, window) for a, b in zip(nodes[0::2], nodes[1::2])]
        nodes = pairs + ([nodes[-1]] if len(nodes) % 2 else [])
    return nodes[0]


# -- Over tables ----------------------------------------------------------------------

_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _ids_array(rows: list) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.empty(0, np.int32), *(np.asarray(r, np.uint32).astype(np.int32) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _ids_columns(codec: Codec, rows: list) -> list[pa.Array]:
    return [_ids_array(rows)]


def _digest_columns(codec: Codec, rows: list) -> list[pa.Array]:
    counts, of_ids, of_texts = [], [], []
    digits = codec.digits
    for ids in rows:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        counts.append(len(ids))
        of_ids.append(hashlib.sha256(b",".join([digits[i] for i in ids])).hexdigest())
        of_texts.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]


def _both_columns(codec: Codec, rows: list) -> list[pa.Array]:
    return [*_digest_columns(codec, rows), *_ids_columns(codec, rows)]


_IDS = "ids array<int>"
_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"

#: What can be made of a text's tokens where they are found: its columns and their types.
OUTPUTS = {
    "ids": (_ids_columns, _IDS),
    "digests": (_digest_columns, _DIGESTS),
    "both": (_both_columns, f"{_DIGESTS}, {_IDS}"),
}


def _short(path: str, output: str):
    """Texts of one piece: all tokens at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, (columns, ddl) = _codec(path), OUTPUTS[output]
        names = [f.split()[0] for f in ddl.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids = [codec.encode(t or "") for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns(codec, ids)], names=[*part.schema.names[1:], *names])

    return run


_PLACE = "text_key string, section int, piece int, special int"
_PIECE = f"{_PLACE}, text string"
_ENCODED = f"{_PLACE}, ids binary"


def _pieces(path: str, piece_chars: int):
    """Long texts cut at special tokens into sections, and these into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for n, (section, special) in enumerate(codec.sections(text)):
                    mark = codec.special[section] if special else -1
                    for k, at in enumerate(range(0, len(section), piece_chars)):
                        rows.append((key, n, k, mark, section[at : at + piece_chars]))
                for begin in range(0, len(rows), BATCH_ROWS):
                    columns = list(zip(*rows[begin : begin + BATCH_ROWS]))
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    names = ("text_key", "section", "piece", "special", "text")
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _encoded_pieces(path: str):
    """The tokens of each piece in place of its text, which they spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids = [
                    np.array([special]) if special >= 0 else codec.encode_plain(text)
                    for special, text in zip(part.column(3).to_pylist(), part.column(4).to_pylist())
                ]
                packed = pa.array([i.astype(codec.packed).tobytes() for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], packed], names=[*part.schema.names[:4], "ids"])

    return run


def _joined_pieces(path: str, window: int, output: str):
    """Pieces of one text to its tokens."""

    def run(table: pa.Table) -> pa.Table:
        codec, (columns, ddl) = _codec(path), OUTPUTS[output]
        rows = sorted(table.to_pylist(), key=lambda r: (r["section"], r["piece"]))
        ids, nodes = [], []
        for n, row in enumerate(rows):
            own = np.frombuffer(row["ids"], codec.packed).tolist()
            if row["special"] >= 0:
                ids += own
                continue
            nodes.append(Node(codec.decode(own), own))
            if n + 1 == len(rows) or rows[n + 1]["section"] != row["section"]:
                ids += tree_joined(codec, nodes, window).ids
                nodes = []
        names = [f.split()[0] for f in ddl.split(", ")]
        return pa.table([pa.array([rows[0]["text_key"]]), *columns(codec, [ids])], names=["text_key", *names])

    return run


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    output: str = "ids",
    piece_chars: int = PIECE_CHARS,
    window: int = WINDOW_CHARS,
) -> DataFrame:
    """Rows (row, ...): ``row`` holds the columns ``keep`` of the input (all by default), so
    none can clash with what follows: ``ids``, the tokens, or what else ``OUTPUTS`` names.

    A null text counts as empty and has no tokens. Strings of special tokens in a text are
    special tokens. ``tokenizer_path`` must be readable on the executors. A text longer than
    ``piece_chars`` is encoded once however many rows hold it; its tokens meet in the task
    that makes its row, since a row is one value. Its pieces are cut where it is read, and each
    moves once, as text, to where it is encoded; from there on tokens alone move.
    """
    from pyspark.sql.types import StructType

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    rows = docs.select(text.alias("text"), kept.alias("row"))
    ddl = OUTPUTS[output][1]
    schema = StructType([rows.schema["row"], *StructType.fromDDL(ddl).fields])
    is_long = F.length("text") > piece_chars
    short = rows.where(~is_long).mapInArrow(lean(_short(tokenizer_path, output)), schema)
    long_rows = rows.where(is_long).withColumn("text_key", F.sha2("text", 256))
    pieces = long_rows.select("text_key", "text").mapInArrow(lean(_pieces(tokenizer_path, piece_chars)), _PIECE)
    once = pieces.dropDuplicates(["text_key", "section", "piece"])
    encoded = once.mapInArrow(lean(_encoded_pieces(tokenizer_path)), _ENCODED)
    joined = written(
        encoded.groupBy("text_key").applyInArrow(_joined_pieces(tokenizer_path, window, output), f"text_key string, {ddl}"),
        "bpe-long",
    )
    whole = long_rows.select("row", "text_key").join(joined, "text_key").select(*short.columns)
    return short.unionByName(whole)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("row",)) -> DataFrame:
    """The columns ``keep`` with ``decoded``, the text of the tokens; null ids give a null. The
    ids' own column can be among ``keep``."""
    from pyspark.sql.types import StringType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [None if i is None else codec.decode(i) for i in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.column(1).flatten(), pa.array(texts, pa.string())], names=[*keep, "decoded"]
                )

    # apart from what is kept, so that no name can clash
    chosen = rows.select(F.col(f"`{ids_col}`").alias("ids"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    schema = StructType([rows.schema[c] for c in keep]).add("decoded", StringType())
    return chosen.mapInArrow(lean(run), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode(docs, tokenizer_path or default_tokenizer(), keep=["doc_id"], output="digests")
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
