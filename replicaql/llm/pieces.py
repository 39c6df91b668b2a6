"""SentencePiece encoding and decoding (9): unigram Viterbi over a double-array trie of pieces.

Spaces become the white-space marker, with one marker in front of the text; the segmentation with the highest sum of
log scores wins, ties to the piece that starts first. A character that no piece covers costs the lowest score less
ten and is written as its UTF-8 bytes. Where the file is a BPE model, whose scores are merge ranks, a piece of rank r
gets the log probability of a Zipf law, -log(r + 1) - log(H). Decoding joins the pieces, turns markers into spaces and
drops the one in front; a literal marker character in a text is written as bytes, so every text comes back exactly.

No piece holds a marker after another character, and white-space characters in no piece stand alone, so texts are cut
there and the cuts' encodings are kept in a bounded memo; the result is that of Viterbi over the whole text.

Defined results: a null text gives null ids and 0 tokens, an empty text an empty list; other columns pass through.
The vocabulary is never trained or changed and its size bounds the broadcast.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO = 400_000  # cuts kept by a Python worker
MEMO_CHARS = 40


class DoubleArray:
    """A trie over bytes: the child of s by byte b is base[s] + b + 1 if check[...] is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in zip(keys, values, strict=True):
            at = 0
            for b in key:
                nxt = tree[at].get(b)
                if nxt is None:
                    nxt = tree[at][b] = len(tree)
                    tree.append({})
                at = nxt
            ends[at] = value
        size = 2 * len(tree) + 1024
        base, check, value, free, crowded, top = [0] * size, [-1] * size, [-1] * size, 1, 1, 1
        check[0] = 0
        todo = [(0, 0)]
        for node, slot in todo:
            value[slot] = ends.get(node, -1)
            if not tree[node]:
                continue
            labels = sorted(tree[node])
            while check[free] >= 0:
                free += 1
            # single children fill holes; others get a few tries behind the last crowded place, then the end
            at = max((free if len(labels) == 1 else max(free, crowded)) - labels[0] - 1, 0)
            for tries in range(40):
                if at + 258 > len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[at + b + 1] < 0 for b in labels):
                    break
                at += 1
            else:
                at, crowded = max(top - labels[0], 0), crowded + 20
            if at + 258 > len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            top = max(top, at + labels[-1] + 1)
            base[slot] = at
            for b in labels:
                check[at + b + 1] = slot
                todo.append((tree[node][b], at + b + 1))
        self.base, self.check, self.value = base[: top + 258], check[: top + 258], value[: top + 258]

    def __getstate__(self):
        return [array("i", x) for x in (self.base, self.check, self.value)]

    def __setstate__(self, state):
        self.base, self.check, self.value = map(list, state)


class Pieces:
    """A vocabulary: pieces with log scores, byte pieces, and the trie."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], plain: list[int]):
        self.scores, self.byte_ids = scores, byte_ids
        self.raw = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self.trie = DoubleArray([self.raw[i] for i in plain], plain)
        self.unknown = min(scores[i] for i in plain) - 10
        held = set("".join(pieces[i] for i in plain))
        alone = "".join(c for c in "\t\n\r\x0b\x0c" if c not in held)
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            self.cut = re.compile(r"(?s).+")
        else:
            self.cut = re.compile(rf"[{alone}]| *[^ {alone}]+| +" if alone else r"(?s) *[^ ]+| +")
        self.memo: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = [m.get_score(i) for i in range(n)]
        if all(s == round(s) for s in scores):  # merge ranks of a BPE model
            total = math.log(sum(1 / (k + 1) for k in range(n)))
            scores = [-math.log(min(-s, n) + 1) - total for s in scores]
        return cls(pieces, scores, byte_ids, plain)

    def best(self, raw: bytes) -> list[int]:
        """Viterbi over one cut."""
        n = len(raw)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        score, back = [-math.inf] * (n + 1), [(-1, 0)] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            here = score[i]
            if here == -math.inf:
                continue
            wide = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
            s, known = 0, False
            for j in range(i, n):
                t = base[s] + raw[j] + 1
                if check[t] != s:
                    break
                s = t
                v = value[s]
                if v >= 0:
                    known = known or j + 1 == i + wide
                    new = here + scores[v]
                    if new > score[j + 1]:
                        score[j + 1], back[j + 1] = new, (v, i)
            if not known and here + self.unknown > score[i + wide]:
                score[i + wide], back[i + wide] = here + self.unknown, (-1, i)
        out: list[int] = []
        while n:
            v, i = back[n]
            out += [v] if v >= 0 else [self.byte_ids[b] for b in reversed(raw[i:n])]
            n = i
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        memo, out = self.memo, []
        for cut in self.cut.findall(" " + text):
            got = memo.get(cut)
            if got is None:
                ids = self.best(cut.encode())
                got = struct.pack(f"<{len(ids)}i", *ids)
                if len(cut) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[cut] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs and ids (list of int), n_tokens, n_bytes (tokens that are single bytes) and round_trip (decoding gave the text)."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    new = ["ids", "n_tokens", "n_bytes", "round_trip"]
    docs = docs.drop(*new)  # columns of these names are replaced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        lo, hi = min(p.byte_ids), max(p.byte_ids)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                packed = [None if x is None else p.encode(x) for x in texts]
                flat = np.frombuffer(b"".join(x or b"" for x in packed), "<i4")
                lengths = np.array([len(x or b"") // 4 for x in packed], np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                single = np.concatenate([[0], np.cumsum((flat >= lo) & (flat <= hi))])
                trips = [x is None or p.decode(flat[s:e].tolist()) == x for x, s, e in zip(texts, ends[:-1], ends[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in texts]))
                yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(lengths), pa.array(single[ends[1:]] - single[ends[:-1]], pa.int64()), pa.array(trips)], names=[*b.schema.names, *new])

    kinds = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.mapInArrow(run, kinds)


def decode_documents(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """Adds decoded: the text of ids (null for null)."""
    held = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else held.value.decode(x) for x in rows], pa.string())], names=[*b.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "ids", "n_tokens", "n_bytes", "round_trip")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
