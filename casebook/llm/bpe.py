"""Byte-level BPE: exact merges in linear time by a backtracking encoder, and decoding from an offset table."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from casebook.llm.store import process_cache, small_batches

# The pattern that cuts a text before merging, and white space as that pattern means it.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
           rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CACHED_UNITS = 150_000
CACHED_LENGTH = 64


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Units(dict):
    """Encoded pieces of text as int32 bytes; keeps up to ``CACHED_UNITS`` short ones."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= CACHED_LENGTH and len(self) < CACHED_UNITS:
            self[unit] = ids
        return ids


class Tokens:
    """The bytes of every token of a vocabulary: token i is ``blob[offset[i]:offset[i + 1]]``."""

    def __init__(self, vocabulary: str):
        self.spec = json.loads(vocabulary)
        byte_of = _byte_characters()
        self.special = {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}
        names = {i: t for t, i in self.spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.size = max(names, default=-1) + 1
        self.special_ids = set(self.special.values())
        self.token = [b""] * self.size
        for i, t in names.items():
            self.token[i] = t.encode() if i in self.special_ids else bytes(byte_of[c] for c in t)
        self.offset = np.zeros(self.size + 1, dtype=np.int64)
        np.cumsum([len(t) for t in self.token], out=self.offset[1:])
        self.blob = np.frombuffer(b"".join(self.token), dtype=np.uint8)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids; ids outside the vocabulary give nothing."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        start, size = np.append(self.offset[:-1], 0)[ids], np.append(np.diff(self.offset), 0)[ids]
        stop = np.cumsum(size)
        where = np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        data = self.blob[where].tobytes()
        stop = np.append(0, stop)
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(stop[ends[:-1]], stop[ends[1:]], strict=True)]


class ByteBPE(Tokens):
    """Encoder and decoder for one vocabulary, given as the text of its JSON file.

    A piece of text is covered from the left by the longest token that ends up next to a compatible one. Two tokens
    are compatible if merging by rank would never join bytes across their border. Where no token fits, the last one
    is taken back and the next shorter one tried; a position that failed once is never tried again, so the work is
    linear. The cover found this way is the one that merging by rank gives.
    """

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        super().__init__(vocabulary)
        model, special_ids = self.spec.pop("model"), self.special_ids
        ids = model["vocab"]
        self.merge, self.rank, self.parts = {}, [-1] * self.size, [None] * self.size
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[left + right]
            self.merge[ids[left], ids[right]] = r
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = r, (ids[left], ids[right])
        self.length = [len(t) for t in self.token]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.id_of = {}
        self.finder = ahocorasick.Automaton()
        for i in sorted(ids.values(), key=self.rank.__getitem__):
            usable = self.length[i] == 1 if self.parts[i] is None else self._border_holds(*self.parts[i], self.rank[i])
            if i not in special_ids and usable:
                self.id_of[self.token[i]] = i
                self.finder.add_word(self.token[i].decode("latin-1"), i)
        self.finder.make_automaton()
        self.shorter = {}
        self.split = regex.compile(PATTERN).findall
        self.loose = re.compile(r" (?:\s|$)").search
        marks = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, marks)) + ")").split if marks else None
        self.after_space = _Units(lambda u: self._cover(" " + u) if u.isalpha() else self._merge_unit(" " + u))
        self.plain = _Units(self._merge_unit)
        self.pieces = _Units(self._cover)

    def _border_holds(self, x: int, y: int, limit: float) -> bool:
        """Whether no merge of rank under ``limit`` joins x and y, while their own merges are undone last to first."""
        merge, rank, parts = self.merge, self.rank, self.parts
        while True:
            r = merge.get((x, y))
            if r is not None and r < limit:
                return False
            if rank[x] > rank[y]:
                limit, x = rank[x], parts[x][1]
            elif rank[y] >= 0:
                # of two equal merges the left one comes first
                limit, y = rank[y] + 1, parts[y][0]
            else:
                return True

    def _compatible(self, x: int, y: int) -> bool:
        if len(self.pairs) >= 200_000:
            self.pairs.clear()
        known = self.pairs[x, y] = self._border_holds(x, y, float("inf"))
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        if token not in self.shorter:
            t = self.token[token]
            self.shorter[token] = next((self.id_of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id_of), -1)
        return self.shorter[token]

    def _cover(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        n, length = len(data), self.length
        if n == 0:
            return b""
        longest = [-1] * n
        for end, i in self.finder.iter(data.decode("latin-1")):
            longest[end + 1 - length[i]] = i  # of matches with one start the longest ends last
        closed: set[int] = set()
        out: list[int] = []
        at, token, pairs = 0, longest[0], self.pairs
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in closed and (not out or (pairs[key] if (key := (out[-1], token)) in pairs
                                                      else self._compatible(*key))):
                    break
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                closed.add(at)
                last = out.pop()
                at -= length[last]
                token = self._next_shorter(last)
        return array("i", out).tobytes()

    def _merge_unit(self, unit: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split(unit)])

    def _ordinary(self, text: str) -> bytes:
        if self.loose(text):
            return b"".join([self.pieces[p] for p in self.split(text)])
        # a space before a visible character is always the start of a piece
        units = text.split(" ")
        return self.plain[units[0]] + b"".join(map(self.after_space.__getitem__, units[1:]))

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as int32 bytes; a null text is empty. Special tokens in the text keep their ids."""
        if not text:
            return b""
        if self.specials is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else self._ordinary(p)
                        for p in self.specials(text) if p)


def _codec(kind: type, vocabulary: str) -> Tokens:
    cache = process_cache()
    key = (kind.__name__, len(vocabulary), zlib.crc32(vocabulary.encode()))
    if key not in cache:
        cache[key] = kind(vocabulary)
    return cache[key]


def _vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array, names: list[str]) -> pa.RecordBatch:
    columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {name: values}
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _plus(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*[f for f in df.schema.fields if f.name != name], StructField(name, kind)])


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", rows: int = 500) -> DataFrame:
    """``df`` with an array of token ids; no shuffle.

    The vocabulary file is read once on the driver and travels with the job. A null or empty text has no ids. An
    existing column ``ids`` is replaced, other columns pass through.
    """
    vocabulary, schema = _vocabulary(vocabulary_path), _plus(df, ids, ArrayType(IntegerType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ByteBPE, vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = [codec.encode(t) for t in batch.column(text).to_pylist()]
                ends = np.cumsum([0, *[len(x) // 4 for x in found]]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
                yield _with_column(batch, ids, pa.ListArray.from_arrays(pa.array(ends), values), names)

    return small_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded", rows: int = 500) -> DataFrame:
    """``df`` with the text of each array of ids, special tokens included; no shuffle.

    Bytes that are not UTF-8 become U+FFFD; unknown and null ids give nothing; a null array gives an empty text. An
    existing column ``text`` is replaced.
    """
    vocabulary, schema = _vocabulary(vocabulary_path), _plus(df, text, StringType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(Tokens, vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                arrays = batch.column(ids)
                values = arrays.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
                yield _with_column(batch, text, pa.array(codec.decode_all(values, ends), pa.string()), names)

    return small_batches(df).mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids",
                      decoded: str = "decoded", rows: int = 200) -> DataFrame:
    """:func:`encode` and :func:`decode` of its ids in one pass, so that a task needs one Python worker, not two."""
    vocabulary = _vocabulary(vocabulary_path)
    schema = StructType([*[f for f in df.schema.fields if f.name not in (ids, decoded)],
                         StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ByteBPE, vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                found = [codec.encode(t) for t in columns[text].to_pylist()]
                ends = np.cumsum([0, *[len(x) // 4 for x in found]]).astype(np.int32)
                values = np.frombuffer(b"".join(found), dtype=np.int32)
                columns[ids] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                columns[decoded] = pa.array(codec.decode_all(values, ends), pa.string())
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return small_batches(df).mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns that stand for a document's ids and decoded text."""
    return [F.size(ids).cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2(F.col(decoded), 256).alias("decoded_sha256")]
