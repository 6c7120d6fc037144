"""Token ids in Arrow stream files with fixed-size-list batches.

Documents are put in ascending order of doc_id (null ids first, ties by the
text), each is encoded and ended by an end id, and each task writes the run of
ids that it holds as equal-length sequences: batches of `rows` sequences of
`length` ids and of a mask (true: a real id, false: padding after the last id of
a file; a bit each).  Every batch but the last of a file has the same size, so a
mapped file gives any sequence and its mask without copying.  Ids are 16 bits wide
where the vocabulary allows, else 32.

A file is closed when it holds `file_ids` ids, so its size does not follow the
size of a task.  Every attempt of a task writes files of its own names; the index
of documents, written by Spark's committer, names those that count, so a lost
executor or a speculative copy leaves at most unnamed files.

Defined results: a null text is encoded like an empty one (the end id alone);
repeated rows are encoded once each; other columns are ignored; an empty table
gives no files and an empty index.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import UnitEncoder
from .common import materialize, prepare, shared_dir, slices, text_bytes

_LOADED: dict = {}
#: The character that stands for each byte in a byte-level vocabulary, by number: a
#: printable Latin-1 character for itself, the others in order from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted(set(range(256)) - set(_PRINTABLE))
_BYTE_CHARS = "".join(chr(b if b in _PRINTABLE else 256 + _OTHERS.index(b)) for b in range(256))


class TextEncoder:
    """The ids of whole texts as the tokenizers library gives them, as bytes.  Strings
    of added tokens (an end mark in a text) are those tokens; between them, texts are
    encoded by units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tok = Tokenizer.from_file(path)
        self.dtype = "<u2" if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        added = tok.get_added_tokens_decoder()
        self.added = {x.content: i for i, x in added.items()}
        self.plain = not any(x.single_word or x.lstrip or x.rstrip or x.normalized for x in added.values())
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        tokenize, blank = tok.model.tokenize, _BYTE_CHARS[32]

        def word(u: str) -> list[int]:
            if u.isascii():
                return [t.id for t in tokenize(blank + u[1:] if u[0] == " " else u)]
            return [t.id for t in tokenize(u.encode().decode("latin-1").translate(_BYTE_CHARS))]

        self.units = UnitEncoder(lambda u: tok.encode(u, add_special_tokens=False).ids, self.dtype, word)

    def __call__(self, text: str) -> bytes:
        if not any(x in text for x in self.added):
            return self.units(text)
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        one = {x: np.array([i], self.dtype).tobytes() for x, i in self.added.items()}
        return b"".join([one[x] if x in one else self.units(x) for x in self.split.split(text)])


def text_encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file, once for each worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


class SequenceWriter:
    """Packs ids into one stream file."""

    def __init__(self, uri: str, dtype: str, length: int, rows: int):
        import pyarrow as pa
        from pyarrow import fs

        self.pa, self.uri, self.dtype, self.length, self.rows = pa, uri, np.dtype(dtype), length, rows
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(os.path.dirname(path), recursive=True)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = where.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held, self.n_held, self.n_ids = [], 0, 0

    def add(self, ids: bytes) -> int:
        """Append ids; returns where they start in the file."""
        start, n = self.n_ids, len(ids) // self.dtype.itemsize
        self.held.append(ids)
        self.n_held += n
        self.n_ids += n
        if self.n_held >= 4 * self.rows * self.length:
            self._flush(False)
        return start

    def _flush(self, last: bool) -> None:
        pa, flat = self.pa, np.frombuffer(b"".join(self.held), self.dtype)
        step = self.rows * self.length
        whole = len(flat) // step * step
        for a in range(0, whole, step):
            self._batch(flat[a : a + step], step)
        rest = flat[whole:]
        if last and len(rest):
            n = -(-len(rest) // self.length) * self.length
            self._batch(np.concatenate([rest, np.zeros(n - len(rest), self.dtype)]), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest.tobytes()], len(rest)
        del pa

    def _batch(self, flat: np.ndarray, real: int) -> None:
        pa = self.pa
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(flat), pa.array(np.arange(len(flat)) < real))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences and masks of one stream file.  All batches but
    the last have one size, so each is found by its number and read alone; those of a
    local file are mapped, and nothing in them is copied."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.length = self.schema.field("ids").type.list_size
        self.first, self.at, self.now = self.source.tell(), -1, None
        left = self.source.size() - self.first - 8  # the mark of the stream's end
        self.size = self.rows = self.n = 0
        if left > 0:
            self.rows = self._batch(0).num_rows
            self.size = self.source.tell() - self.first
            whole, rest = divmod(left, self.size)
            self.n = whole * self.rows + (self._batch(whole).num_rows if rest else 0)

    def __len__(self) -> int:
        return self.n

    def _batch(self, b: int):
        if b != self.at:
            import pyarrow as pa

            self.source.seek(self.first + b * self.size)
            self.at, self.now = b, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.now

    def _values(self, b: int) -> np.ndarray:
        return self._batch(b).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence i: a view into the file."""
        b, r = divmod(i, self.rows)
        return self._values(b)[r * self.length : (r + 1) * self.length]

    def mask(self, i: int):
        """The mask of sequence i, an Arrow array of booleans: a view into the file."""
        b, r = divmod(i, self.rows)
        return self._batch(b).column(1).flatten().slice(r * self.length, self.length)

    def mask_bits(self, i: int) -> np.ndarray:
        """The same as packed bits, least first: a view into the file, for lengths
        that are multiples of eight."""
        b, r = divmod(i, self.rows)
        bits = np.frombuffer(self._batch(b).column(1).flatten().buffers()[1], np.uint8)
        return bits[r * self.length // 8 : (r + 1) * self.length // 8]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file's run of ids."""
        step, parts = self.rows * self.length, []
        while n > 0:
            b, r = divmod(start, step)
            part = self._values(b)[r : r + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.now = None
        self.source.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, length: int = 2048, rows: int = 32, file_ids: int = 1 << 27) -> DataFrame:
    """Encode docs(doc_id, text) into stream files below `folder` (a URI of a
    shared store).  Returns the index, read from `folder`/index: doc_id, part,
    file_no, file, file_start, n_tokens."""
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "part", "file_no", "file", "file_start", "n_tokens"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = text_encoder(tokenizer_path)
        dtype = coder.dtype
        end = np.array([end_id], dtype).tobytes()
        out, file_no, uri = None, -1, ""
        for rb in batches:
            raw = rb.column(1).to_pylist()
            for a, b in slices(raw, 4_000_000):
                files, nos, starts, counts = [], [], [], []
                for ids in (coder(t.decode("utf-8", "replace")) for t in raw[a:b]):
                    if out is None or out.n_ids >= file_ids:
                        if out:
                            out.close()
                        file_no += 1
                        uri = f"{folder}/ids/part-{part:07d}-{file_no:05d}-{uuid.uuid4().hex[:12]}.arrows"
                        out = SequenceWriter(uri, dtype, length, rows)
                    starts.append(out.add(ids + end))
                    counts.append(out.n_ids - starts[-1])
                    files.append(uri)
                    nos.append(file_no)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), pa.array([part] * (b - a), pa.int32()), pa.array(nos, pa.int32()), pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=names)
        if out:
            out.close()

    key, text = docs["doc_id"], text_bytes(docs)
    # Ranges of ids alone: the sampling of their bounds then reads no text.
    placed = docs.select(key, text.alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "tie")
    index = placed.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, file_no int, file string, file_start long, n_tokens long")
    return materialize(index, f"{folder}/index")


def read_token_files(index: DataFrame) -> DataFrame:
    """Read every document's ids back from the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 of the ids as little-endian
    unsigned 32-bit integers.  Only one row a file is gathered for the starts."""
    import pyarrow as pa

    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches):
        uri, held = None, None
        for rb in batches:
            sums = []
            for file, start, n in zip(*(rb.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if file != uri:
                    if held:
                        held.close()
                    uri, held = file, SequenceFile(file)
                sums.append(zlib.crc32(held.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(4), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = index.groupBy("part", "file_no").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("part", "file_no", before.alias("before"))
    placed = index.join(files, ["part", "file_no"]).select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "file", "file_start", "n_tokens")
    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path, shared_dir(spark)))
