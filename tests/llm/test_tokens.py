import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from textloom.llm import bpe, token_files
from textloom.llm.queries import QUERIES

ODD = [None, "", " ", "a", "  two  blanks \n\n end \n", "tab\tand odd space \x1c x", "don't we'll  I'M", "<|endoftext|> here", "x" * 30000, "é" * 500 + "  " * 900, "日本語 テキスト\r\nmore\r\n", "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(ODD)] + [(None, "no id", "x", 0), (3, "tie", "x", 1), (3, "tie", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def plain_tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_units_join_and_are_safe():
    enc = plain_tiktoken()
    for t in ODD:
        t = t or ""
        assert "".join(bpe.units(t)) == t
        assert [i for u in bpe.units(t) for i in enc.encode_ordinary(u)] == enc.encode_ordinary(t)


def test_encode_decode(spark, odd):
    enc = plain_tiktoken()
    got = bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True)
    texts = sorted((t or "") for t in [r.text for r in odd.collect()])
    rows = got.collect()
    assert sorted(bytes(r.decoded).decode() for r in rows) == texts
    for r in rows:
        assert r.ids == enc.encode_ordinary(bytes(r.decoded).decode())
    again = bpe.decode_documents(got, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted(bytes(r.decoded) for r in rows)


HARD = ["don't! can't, 'tis 's' it's'll", "(brackets) [x], y", "a,b;c 1,000.00 2nd 3rd.", "tab\tword,\t next  one.\t\t end", "é, ñandú! Ǆ. ɐ. ß? \u180e x\u180e y", "\1 odd \1odd \1", "x_ y__ z'", "nbsp\xa0 here,\xa0 and \x85 there\x1d now", "a \n\n b\n\n\nc.\nd,\n", "²³½ x², y½. ٣.", "word" * 40 + ", " + "日本語、" * 50, "e\u0301, a\u0301\u0302!", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endoftext"]


def test_units_of_hard_texts():
    enc, coder = bpe.tiktoken_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own = token_files.text_encoder(P.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    alphabet = list("ab é1,.'!\n\n  \t") + ["\xa0", "'s", "日", "\u3000", "\1", "  ", "<|endoftext|>"]
    mixed = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(3000)]
    for t in HARD + mixed + HARD:
        assert "".join(bpe.units(t)) == t
        assert np.frombuffer(coder(t), "<i4").tolist() == enc.encode_ordinary(t), t
        assert np.frombuffer(own(t), own.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert np.frombuffer(own("<|endoftext|> here"), own.dtype).tolist() == [50256, 994]


def test_memory_of_units_is_bounded():
    enc, _ = bpe.tiktoken_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    coder = bpe.UnitEncoder(enc.encode_ordinary, "<i4", most=50)
    rng = np.random.default_rng(2)
    for _ in range(40):
        t = " ".join(f"w{x}," for x in rng.integers(0, 300, 60))
        assert np.frombuffer(coder(t), "<i4").tolist() == enc.encode_ordinary(t)
        assert len(coder.memory) <= 100 and len(coder.memory.old) <= 100


def test_op5(spark, sf):
    enc = plain_tiktoken()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op5_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def expected_op1(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(map(tuple, QUERIES["op1_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected_op1(rows)


def test_token_files_odd_rows_and_small_files(spark, odd, tmp_path):
    index = token_files.write_token_files(odd, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/t", length=16, rows=3, file_ids=100)
    got = token_files.read_token_files(index).collect()
    assert len(got) == odd.count()
    want = {(a, n, c) for a, _, n, c in expected_op1([(r.doc_id, r.text) for r in odd.collect()])}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    files = {r.file for r in index.collect()}
    assert len(files) > 1
    for uri in files:
        f = token_files.SequenceFile(uri)
        real = sum(r.n_tokens for r in index.where(index.file == uri).collect())
        masks = [f.mask(i) for i in range(len(f))]
        assert sum(m.to_pylist().count(True) for m in masks) == real and all(len(m) == 16 for m in masks)
        assert all((np.unpackbits(f.mask_bits(i), bitorder="little") == m.to_numpy(zero_copy_only=False)).all() for i, m in enumerate(masks))
        assert not f.mask_bits(0).flags.owndata and f.mask(len(f) - 1).to_pylist()[-1] == (real % 16 == 0)
        whole = np.concatenate([f.sequence(i) for i in range(len(f))])
        assert len(whole) == 16 * len(f) and (whole[:real] == f.ids(0, real)).all()
        assert not f.sequence(0).flags.owndata  # a view into the file
        f.close()


def test_empty_table(spark, odd, tmp_path):
    none = odd.limit(0)
    assert bpe.digests(bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True)).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/e")).count() == 0
