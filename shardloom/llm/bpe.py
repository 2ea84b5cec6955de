"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that byte-pair merging
leaves last. The suffix links of an automaton over the vocabulary (a trie of the
tokens with links to their longest suffixes, not the suffix automaton of a text:
the links that are followed are the same) list the tokens that end at a
position, longest first; a token is the last one if it is
compatible with the last token of the prefix before it, that is, if merging the
two tokens' bytes gives the same two tokens back. Back-pointers then give the
ids, exactly as merging in rank order would.

Pieces (the pre-tokenizer's matches) are encoded once for each worker while
they stay in a bounded table; texts never leave the task that read them.

The vocabulary file is read by the driver and sent to the workers. A file that
asks for anything else than byte-level pieces and plain merges (a normalizer,
another pre-tokenizer, ignored merges, word ends, tokens that strip spaces) is
refused, as its ids would be others.

Defined results: null text is empty and has no ids; extra columns are carried
along; an empty table gives an empty table; a text of one very long piece is
encoded in time linear in its length.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from shardloom.llm.common import arrow_map, raw

#: Pieces that a worker keeps the ids of, in each of two tables: when the newer is full it becomes the older.
PIECES = 1 << 18
#: Token pairs that a worker remembers the test of.
PAIRS = 1 << 18
#: Fixed value: the piece pattern of a byte-level pre-tokenizer with use_regex.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What a vocabulary file must say of its model, its pre-tokenizer and its added tokens.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
ADDED_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def refuse_others(spec: dict) -> None:
    """An error for a vocabulary file that asks for what Encoder does not do."""
    wants = [("normalizer", spec.get("normalizer"), None), ("post_processor", spec.get("post_processor"), None)]
    wants += [(f"model.{k}", spec["model"].get(k, v) or v, v) for k, v in MODEL.items()]
    wants += [(f"pre_tokenizer.{k}", (spec.get("pre_tokenizer") or {}).get(k), v) for k, v in PRE_TOKENIZER.items()]
    wants += [(f"added token {x['content']}: {k}", x.get(k, v), v) for x in spec.get("added_tokens", []) for k, v in ADDED_TOKEN.items()]
    wrong = [f"{name} is {found!r}" for name, found, want in wants if found != want]
    if wrong:
        raise ValueError("this vocabulary file is not supported: " + "; ".join(wrong))


class Encoder(dict):
    """Maps a piece to its ids as little-endian unsigned 32-bit integers; text: a vocabulary file's."""

    def __init__(self, text: str, pieces: int = PIECES):
        super().__init__()
        spec = json.loads(text)
        refuse_others(spec)
        model, symbols = spec["model"], byte_symbols()
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        vocab = model["vocab"]
        self.pieces, self.older, self.pattern = pieces, {}, regex.compile(BYTE_LEVEL)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.width = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes = [b""] * self.width
        self.rank, self.halves, self.pair = [-1] * self.width, [None] * self.width, {}
        for token, i in vocab.items():
            self.bytes[i] = bytes(symbols[c] for c in token)
        for order, (left, right) in enumerate(merges):
            whole, a, b = vocab[left + right], vocab[left], vocab[right]
            self.pair.setdefault(a * self.width + b, order)
            if self.halves[whole] is None:
                self.rank[whole], self.halves[whole] = order, (a, b)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.automaton = ahocorasick.Automaton()
        self.self_made = [h is not None or len(b) == 1 for h, b in zip(self.halves, self.bytes, strict=True)]
        for i in set(vocab.values()):
            if self.self_made[i] and self._own(i):
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.sizes = [len(x) for x in self.bytes]
        self.compatible: dict[int, bool] = {}

    def _own(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token: its last merge is the first one possible across its halves."""
        if self.halves[token] is None:
            return True
        left, right = self.halves[token]
        return self._first_across(left, right) == self.rank[token]

    def _first_across(self, left: int, right: int) -> int | None:
        """Rank of the merge that joins the two tokens' bytes across their border; none: None.

        Undoes the later of the two tokens' merges again and again. A merge
        across the border happens if its rank is below that of the merge just
        undone; of equal ranks the one further left comes first.
        """
        pair, rank, halves, width = self.pair, self.rank, self.halves, self.width
        bound, found = len(pair) + 1, None
        while True:
            across = pair.get(left * width + right)
            if across is not None and across < bound:
                found = across
            if rank[left] > rank[right]:
                bound, left = rank[left], halves[left][1]
            elif rank[right] >= 0:
                bound, right = rank[right] + 1, halves[right][0]
            else:
                return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens."""
        key = left * self.width + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._first_across(left, right) is None
        return known

    def ids_of(self, piece: bytes) -> list[int]:
        """The ids of a piece, from the last token of each of its prefixes."""
        last, sizes, known, width = [-1] * (len(piece) + 1), self.sizes, self.compatible.get, self.width
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - sizes[token]
                if not start:
                    last[end] = token
                else:
                    before = last[start]
                    fits = known(before * width + token)
                    if self.fits(before, token) if fits is None else fits:
                        last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        return ids[::-1]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            packed = array("I", self.ids_of(piece.encode()))
            if sys.byteorder == "big":
                packed.byteswap()
            ids = packed.tobytes()
        if len(piece) <= 64:
            if len(self) >= self.pieces:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.specials is None or not any(x in text for x in self.added):
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        out = []
        for part in self.specials.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            else:
                out += map(self.__getitem__, self.pattern.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids' text; broken sequences become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").encode()


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


_encoders: dict[str, Encoder] = {}


def sent(spark, path: str) -> Callable[[], Encoder]:
    """What gives a worker its encoder for a vocabulary file of the driver's: built once in each worker."""
    text = read_vocabulary(path)
    refuse_others(json.loads(text))
    key, shared = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)

    def encoder() -> Encoder:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        return _encoders[key]

    return encoder


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids (binary, little-endian unsigned 32-bit) and n_tokens; text_col stays as it is."""
    keep = [c for c in df.columns if c not in (ids_col, "n_tokens")]
    wide = df.select(raw(text_col).alias("__raw"), *[F.col(f"`{c}`") for c in keep])
    types = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{ids_col}` binary", "n_tokens long"])

    encoder = sent(df.sparkSession, path)

    def over(batch):
        encode = encoder().encode
        ids = [encode(x.decode()) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[*keep, ids_col, "n_tokens"])

    return arrow_map(wide, over, types)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of packed ids; null ids decode to the empty text."""
    keep = [c for c in df.columns if c != out_col]
    wide = df.select(F.coalesce(F.col(ids_col), F.lit(b"")).alias("__ids"), *[F.col(f"`{c}`") for c in keep])
    types = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out_col}` string"])

    encoder = sent(df.sparkSession, path)

    def over(batch):
        decode = encoder().decode
        texts = pa.array([decode(x) for x in batch.column(0).to_pylist()], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*keep, out_col])

    return arrow_map(wide, over, types)


def bpe_roundtrip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """bpe_encode, then bpe_decode of its ids, in one Python worker a task instead of two; text_col is left out."""
    keep = [c for c in df.columns if c not in (text_col, ids_col, "n_tokens", out_col)]
    wide = df.select(raw(text_col).alias("__raw"), *[F.col(f"`{c}`") for c in keep])
    types = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{ids_col}` binary", "n_tokens long", f"`{out_col}` string"])

    encoder = sent(df.sparkSession, path)

    def over(batch):
        own = encoder()
        ids = [own.encode(x.decode()) for x in batch.column(0).to_pylist()]
        texts = pa.array([own.decode(x) for x in ids], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), texts], names=[*keep, ids_col, "n_tokens", out_col])

    return arrow_map(wide, over, types)


def ids_array(ids_col: str = "ids"):
    """Column expression: packed ids as array<int>."""
    part = lambda x: F.conv(F.concat(*[F.substring(x, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.transform(F.regexp_extract_all(F.hex(ids_col), F.lit("[0-9A-F]{8}"), F.lit(0)), part)
