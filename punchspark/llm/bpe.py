"""Byte-level BPE encoding and decoding, with tree concatenation for long texts.

A document of at most ``leaf_chars`` characters is encoded in one piece, in the task that
reads it. A longer one is cut into leaves of that length, wherever the cut falls; the leaves
are dealt out over the cluster and encoded in parallel, and the leaves of a document are
joined pairwise up a binary tree. A join re-encodes a window that grows around the cut until
both sides agree exactly:

* The pre-tokeniser reads from left to right and keeps no state, so pieces of the left side
  that end ``LOOKAHEAD`` characters or more before the cut stay as they are. From there the
  window is split anew and grows to the right until one of its piece ends is also a piece end
  of the right side; all pieces after it stay as they are.
* A piece that runs through the cut (text with nothing to split at) is joined by its tokens:
  the last k tokens of the left and the first k of the right are re-encoded, and k doubles
  until the new tokens begin with the left side's first token of the window and end with the
  right side's last. A BPE sequence is the encoding of its bytes exactly if every two
  neighbours are, so agreement at both ends settles the whole.

Encoding uses the ranks of the tokeniser file through the installed BPE library. Special
tokens named in the file are cut out first and have their own ids.

Defined results: a null text counts as empty and has no tokens. Rows are told apart by an
(id, digest of the text) pair; repeated rows each get their row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchspark.llm.common import blocks

LEAF_CHARS = 32_768
LOOKAHEAD = 4
"""Characters beyond a piece's end that the pattern can look at, and one to spare (the longest contraction has three)."""

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: the pre-tokeniser pattern of the byte-level vocabulary."""


def _byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary file writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Coder:
    """One tokeniser file, loaded once in each worker."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.text = [str(i) for i in range(len(self.bytes))]
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches (text, None) and special tokens (text, id), in order."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        for part, special in self.segments(text):
            out += self.bpe.encode_ordinary(part) if special is None else [special]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def piece(self, text: str) -> list[int]:
        return list(self.bpe._encode_single_piece(text))

    def leaf(self, text: str) -> Node:
        """A stretch with its pieces."""
        ids, pieces = [], []
        for m in self.pieces.finditer(text):
            own = self.piece(m[0])
            ids += own
            pieces.append((len(m[0]), len(own)))
        return Node(text, ids, pieces)

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of one piece from the tokens of its two parts."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            new = self.piece_bytes(b"".join(map(self.bytes.__getitem__, a + b)))
            whole_a, whole_b = len(a) == len(left), len(b) == len(right)
            if (whole_a or new[0] == a[0]) and (whole_b or new[-1] == b[-1]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            k *= 2

    def piece_bytes(self, data: bytes) -> list[int]:
        return list(self.bpe._encode_single_piece(data))

    def join(self, left: Node, right: Node) -> Node:
        """The node of left + right; see the module's text."""
        text = left.text + right.text
        cut = len(left.text)
        kept, at, kept_ids = len(left.pieces), cut, len(left.ids)
        while kept and at > cut - LOOKAHEAD:
            kept -= 1
            at -= left.pieces[kept][0]
            kept_ids -= left.pieces[kept][1]
        ends, end, end_ids = {cut: (0, 0)}, cut, 0
        for k, (chars, n) in enumerate(right.pieces):
            end, end_ids = end + chars, end_ids + n
            ends[end] = (k + 1, end_ids)
        reach = 64
        while True:
            stop = min(len(text), cut + reach)
            new, pos, agreed = [], at, None
            for m in self.pieces.finditer(text, at, stop):
                if stop < len(text) and m.end() > stop - LOOKAHEAD:
                    break
                new.append((m.start(), m.end()))
                pos = m.end()
                if pos > cut and pos in ends or pos == len(text):
                    agreed = pos
                    break
            if agreed is not None or at == len(text):
                break
            reach *= 4
        ids, pieces = left.ids[:kept_ids], left.pieces[:kept]
        for s, e in new:
            if s < cut < e and self._whole(left, s) and e in ends and ends[e][0] == 1:
                own = self.join_tokens(left.ids[len(left.ids) - left.pieces[-1][1] :], right.ids[: ends[e][1]])
            else:
                own = self.piece(text[s:e])
            ids += own
            pieces.append((e - s, len(own)))
        k, n = ends.get(agreed, (len(right.pieces), len(right.ids)))
        return Node(text, ids + right.ids[n:], pieces + right.pieces[k:])

    @staticmethod
    def _whole(left: Node, start: int) -> bool:
        """Whether the left side's last piece starts there."""
        return bool(left.pieces) and start == len(left.text) - left.pieces[-1][0]

    def tree(self, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [self.join(*nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0]


class Node:
    """A stretch of text, its tokens, and its pieces as (characters, tokens)."""

    __slots__ = ("text", "ids", "pieces")

    def __init__(self, text: str, ids: list[int], pieces: list[tuple[int, int]]):
        self.text, self.ids, self.pieces = text, ids, pieces


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


RESULT = "id long, was_null boolean, n_chars long, ids array<int>, decoded string"
DIGEST = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(c: Coder, rows: list[tuple], digest: bool) -> pa.RecordBatch:
    """rows: (id, was_null, n_chars, ids)."""
    decoded = [c.decode(r[3]) for r in rows]
    if digest:
        text = c.text
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[3]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(",".join([text[i] for i in r[3]]).encode()).hexdigest() for r in rows], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            ],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.bool_()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            pa.array(decoded, pa.string()),
        ],
        ["id", "was_null", "n_chars", "ids", "decoded"],
    )


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, digest: bool = False) -> DataFrame:
    """One row per input row: id, was_null, n_chars, ids, decoded; with ``digest`` id, n_tokens and the two digests.

    ``tokenizer`` is the path of the tokeniser file on every worker.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = DIGEST if digest else RESULT

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for part in blocks(batches, "text", 1 << 20):
            texts = part.column("text").to_pylist()
            ids = part.column("id").to_pylist()
            yield _result(c, [(i, t is None, len(t or ""), c.encode(t or "")) for i, t in zip(ids, texts)], digest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves: (id, copy, leaf, kind, text); ``copy`` tells repeated rows apart, a special token is a leaf of kind 1."""
        from pyspark import TaskContext

        c, place, copy = coder(tokenizer), TaskContext.get().partitionId(), 0
        for part in blocks(batches, "text", 1 << 20):
            out = []
            for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                leaf = 0
                for k, (stretch, special) in enumerate(c.segments(t)):
                    for s in range(0, len(stretch), leaf_chars) if special is None else (0,):
                        out.append((i, place, copy, leaf, k, special, stretch[s : s + leaf_chars] if special is None else stretch))
                        leaf += 1
                copy += 1
            cols = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, types)], ["id", "place", "copy", "leaf", "stretch", "special", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for part in blocks(batches, "text", 1 << 20):
            nodes = [c.leaf(t) if s is None else Node(t, [s], [(len(t), 1)]) for t, s in zip(part.column("text").to_pylist(), part.column("special").to_pylist())]
            arrays = [pa.array([n.ids for n in nodes], pa.list_(pa.int32()))]
            arrays += [pa.array([[p[k] for p in n.pieces] for n in nodes], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, "ids", "piece_chars", "piece_ids"])

    def join_leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        c = coder(tokenizer)
        pdf = pdf.sort_values("leaf")
        ids: list[int] = []
        chars = 0
        for _, own in pdf.groupby("stretch", sort=True):
            nodes = [Node(t, list(i), list(zip(a, b))) for t, i, a, b in zip(own["text"], own["ids"], own["piece_chars"], own["piece_ids"])]
            node = c.tree(nodes)
            ids += [int(i) for i in node.ids]
            chars += len(node.text)
        first = pdf["id"].iloc[0]
        return _result(c, [(None if pd.isna(first) else int(first), False, chars, ids)], digest).to_pandas()

    long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    done = rows.where(~long).mapInArrow(short, schema)
    leaves = rows.where(long).mapInArrow(cut, "id long, place int, copy long, leaf int, stretch int, special int, text string")
    leaves = leaves.repartition("place", "copy", "leaf").mapInArrow(
        encode_leaves, "id long, place int, copy long, leaf int, stretch int, special int, text string, ids array<int>, piece_chars array<int>, piece_ids array<int>"
    )
    return done.unionByName(leaves.groupBy("place", "copy").applyInPandas(join_leaves, schema))


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the text of the ids (null for null ids), as lossy UTF-8."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        c = coder(tokenizer)
        return pd.Series([None if i is None else c.decode(i) for i in ids], dtype=object)

    return encoded.withColumn("decoded", text(F.col(f"`{ids_col}`")))
