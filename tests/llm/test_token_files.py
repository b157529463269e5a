"""Operator 12: bit packing, random access, files of a table against the tokenizers library."""

import os
import zlib

import numpy as np
import pytest

import public_tokenizers as P
from notedrift.llm import token_files as T

JSON = P.path("byte_bpe_50k.json")
SHAPE = "doc_id long, text string, key int, ids int, n int, start int, crc int, row int"
TEXTS = [None, "", " ", "a" * 4000, "x y " * 9000, "a<|endoftext|>b", "it's we'll 中文 é " * 200, "same words", "same words", "\n \t" * 99]


def test_pack_and_unpack_every_width():
    rng = np.random.default_rng(0)
    for bits in range(1, 33):
        for n in (0, 1, 7, 8, 9, 64, 1001):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            data = T.pack(ids, bits)
            assert len(data) == -(-n * bits // 8)
            assert (T.unpack(data, n, bits) == ids).all()
            # the format by definition: bit j of id i is bit i * bits + j of the string
            want = np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()
            assert data == want
    with pytest.raises(ValueError):
        T.pack(np.array([8], np.uint32), 3)
    assert [T.width(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_file_gives_any_range(scratch):
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 1000, 0, 77, 64]
    ids = rng.integers(0, 1 << 13, sum(sizes)).astype(np.uint32)
    path = os.path.join(scratch, "a.ids")
    out = T.Writer(open(path, "wb"), 13, 64)
    out.append([5, None, 7], np.array(sizes[:3]), ids[:6])
    out.append([8, 9, 10, 11], np.array(sizes[3:]), ids[6:])
    out.close()
    f = T.TokenFile(path)
    assert (f.n_ids, f.n_docs, f.bits) == (len(ids), 7, 13) and f.keys.tolist()[0] == 5 and f.null.tolist() == [0, 1, 0, 0, 0, 0, 0]
    at = np.concatenate(([0], np.cumsum(sizes)))
    for k in range(7):
        assert (f.document(k) == ids[at[k]:at[k + 1]]).all()
    for _ in range(200):
        lo, hi = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (f.ids(lo, hi) == ids[lo:hi]).all()
    assert [x for run in f.runs(100) for x in range(*run)] == list(range(7))
    with pytest.raises(IndexError):
        f.ids(0, len(ids) + 1)
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        T.TokenFile(path).ids(0, 3)


def tables(spark, texts, ids):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1, 1) for i, t in zip(ids, texts)], SHAPE).repartition(3)


def expected(texts, ids):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(JSON)
    rows = []
    for i, t in zip(ids, texts):
        own = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        rows.append((i is not None, i or 0, len(own), zlib.crc32(own.tobytes()), own.tolist()))
    rows.sort()
    out, at = [], 0
    for there, i, n, crc, own in rows:
        out.append((i if there else None, at, n, crc, own))
        at += n
    return out


def test_files_hold_every_document_in_order(spark):
    rng = np.random.default_rng(2)
    texts = TEXTS + ["".join(rng.choice(list("ab '\n\tl9.é中"), size=int(n))) for n in rng.integers(0, 2000, 150)]
    ids = rng.permutation(len(texts)).tolist()
    ids[3] = None
    ids[10] = ids[11] = ids[12] = 40  # an id of several documents
    for options in ({}, {"block_ids": 64, "file_bytes": 5000}):
        manifest = T.write(tables(spark, texts, ids), JSON, P.PATTERN, **options)
        got = sorted(((a, b, c, d, list(e)) for a, b, c, d, e in T.read(manifest, with_ids=True).collect()), key=lambda r: r[1])
        want = expected(texts, ids)
        # the documents of one id stand in an order of their own
        assert sorted((r[0], r[2:]) for r in got if r[0] is not None) == sorted((r[0], r[2:]) for r in want if r[0] is not None)
        assert [r[0] for r in got] == [r[0] for r in want]
        assert [r for r in got if r[0] != 40] == [r for r in want if r[0] != 40]
        assert all(x[1] + x[2] == y[1] for x, y in zip(got, got[1:])) and got[0][1] == 0
        starts = [(r.start, r.n_ids) for r in manifest.orderBy("start").collect()]
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_files_of_one_repeated_id_are_split(spark):
    """Copies under one id go to many files, none of them holds all."""
    texts, ids = ["same text here"] * 400, [7] * 400
    manifest = T.write(tables(spark, texts, ids), JSON, P.PATTERN, file_bytes=200)
    assert manifest.count() > 8
    got = T.read(manifest).collect()
    assert len(got) == 400 and sorted(r.start for r in got) == [r[1] for r in expected(texts, ids)]


def test_files_of_an_empty_table(spark):
    manifest = T.write(tables(spark, [], []), JSON, P.PATTERN)
    assert manifest.count() == 0 and T.read(manifest).collect() == []
