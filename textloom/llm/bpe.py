"""Byte-level BPE: text to ids and ids back to raw bytes.

A text is cut at *safe boundaries*, where a blank or line feed follows a
character that is not white space.  No match of the pre-splitting pattern
crosses such a place, and none looks beyond it (its only lookahead stands after
white space), so the units can be encoded one by one and their ids joined, whatever
other white space a text has and however long it is.

Units return often: each worker keeps a bounded memory of them, from task to task.  A
unit not in it is put together from parts that are: at safe boundaries, and where
marks follow its last letter or digit (a match of the pattern ends there too).  Only
what is left goes to the library.

Defined results: a null text is encoded like an empty one (no ids); bytes that
are not UTF-8 become U+FFFD; repeated rows give repeated results; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, prepare, slices, text_bytes

#: What some regular-expression library may take for white space is none here.
_SAFE = re.compile("(?<=[^\\s\u180e])(?=[ \\n])")
_OTHER_SPACES = [*(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"), "\u180e"]
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Below this, what is a letter or a digit is the same in all versions of Unicode.
_LATIN = "\u0250"
#: Units longer than this are encoded each time anew.
_LONG = 64


def units(text: str) -> list[str]:
    """The text cut at safe boundaries; joined again they are the text."""
    return _SAFE.split(text)


def _even(text: str) -> bool:
    """Whether single blanks, and line feeds away from them, are its only white space
    and stand between words: its units are then its parts between blanks."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or "\1" in text:
        return False
    # A search for each such character is much faster than a regular expression's walk.
    return not any(c in text for c in _OTHER_SPACES)


def _key(unit: str) -> str:
    """Units after a blank are known by what follows it, others with \1 before."""
    return unit[1:] if unit[:1] == " " and unit[1:2] != "\1" else "\1" + unit


class _Memory(dict):
    """Ids (bytes) of units by their keys, those it lacked from the generation before."""

    def __init__(self, coder: UnitEncoder, old: dict):
        self.coder, self.old = coder, old

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            coder = self.coder
            if key.isalpha() and (key.isascii() or max(key) < _LATIN):
                ids = array(coder.code, coder.word(" " + key)).tobytes()
            else:
                unit = key[1:] if key[:1] == "\1" else " " + key
                parts = _SAFE.split(unit) if "\n" in unit or " " in unit[1:] else ()
                if len(parts) > 1:
                    return b"".join([self[_key(p)] for p in parts])
                core = unit.rstrip(_MARKS)
                if core != unit and core[-1:].isalnum() and core[-1] < _LATIN:
                    ids = self[_key(core)] + self["\1" + unit[len(core) :]]
                else:
                    ids = coder.encode(unit)
        if len(key) <= _LONG and len(self) <= self.coder.most:
            self[key] = ids
        return ids


class UnitEncoder:
    """Ids of texts behind a memory of units in two generations: a full one becomes the
    old one, and the one before goes.  A unit takes some 200 bytes.  one(str) gives the
    ids of any text, and word(str), if given, those of a word of Latin letters, with or
    without a blank."""

    def __init__(self, one, dtype, word=None, most: int = 600_000):
        self.one, self.word, self.dtype, self.most = one, word or one, np.dtype(dtype), most
        self.memory = _Memory(self, {})
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]

    def encode(self, unit: str) -> bytes:
        letters = unit[1:] if unit[:1] == " " else unit
        single = letters.isalpha() and (letters.isascii() or max(letters) < _LATIN)
        return array(self.code, self.word(unit) if single else self.one(unit)).tobytes()

    def __call__(self, text: str) -> bytes:
        """Its ids as little-endian integers of the dtype."""
        if len(self.memory) >= self.most:
            full, self.memory.old = self.memory, {}
            self.memory = _Memory(self, full)
        find = self.memory.__getitem__
        if _even(text):
            first, *rest = text.split(" ")
            return find("\1" + first) + b"".join(map(find, rest))
        return b"".join([find(_key(u)) for u in _SAFE.split(text)])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_LOADED: dict = {}


def tiktoken_encoding(path: str, pattern: str):
    """The encoding of a local rank file and its coder of units, once for each worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        # This library encodes a unit fast, so a smaller memory does: 300,000 units at most.
        _LOADED[path, pattern] = enc, UnitEncoder(enc.encode_ordinary, "<i4", most=150_000)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = False) -> DataFrame:
    """Per document: its id, `ids` array<int> and, if asked for, `decoded`
    binary: the bytes that the ids stand for.  One pass over the scan, no shuffle."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        enc, coder = tiktoken_encoding(path, pattern)
        for rb in batches:
            raw = rb.column(1).to_pylist()
            for a, b in slices(raw, 2_000_000):
                found = [coder(t.decode("utf-8", "replace")) for t in raw[a:b]]
                sizes = np.fromiter(map(len, found), np.int64, b - a) // 4
                flat = np.frombuffer(b"".join(found), "<i4")
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                cols = [rb.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                if decode:
                    cols.append(pa.array([enc.decode_bytes(flat[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[id_column, "ids", "decoded"][: len(cols)])
        free_memory()

    schema = f"`{id_column}` {kind}, ids array<int>" + ", decoded binary" * decode
    return docs.select(docs[id_column], text_bytes(docs, text_column).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """`decoded` binary from `ids` array<int> (null: empty bytes)."""
    import pyarrow as pa

    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        enc, _ = tiktoken_encoding(path, pattern)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([enc.decode_bytes(x or []) for x in rb.column(1).to_pylist()], pa.binary())], names=[id_column, "decoded"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents(decode=True)."""
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
