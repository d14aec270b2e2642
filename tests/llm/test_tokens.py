"""Encoding, token files and counts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftline.llm import _common, bpe, token_count, token_file

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdeSTXİǨéÅßſ \n\t\x1c\x85 　é1２Ⅷ½'sdtllverem<|>endoftext🎉日本.,;:!?|"


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(11)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["".join(rng.choice(["the", "é", " ", "\n", "1", "'s", ", ", "ß日", "."]) for _ in range(30)) for _ in range(500)]
    return made + ["a<|endoftext|> b", "<|startoftext|><|endoftext|>", "", "a" * 3000, "".join(rng.choice("etaoinshr") for _ in range(4000)), " " * 50, "x \n y"]


def test_backtracking_is_exact_and_reversible(samples):
    lib, enc = Tokenizer.from_file(BYTE), bpe.BacktrackingEncoder(BYTE)
    for text in samples:
        packed = enc.encode_packed(text)
        assert np.frombuffer(packed, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        assert enc.decode_packed(packed).decode() == text


def test_caches_may_be_cleared(samples, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(token_file, "CACHE_ENTRIES", 3)
    lib, own, enc = Tokenizer.from_file(BYTE), bpe.BacktrackingEncoder(BYTE), token_file.LibraryEncoder(BYTE)
    for text in samples[:200]:
        want = np.array(lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert own.encode_packed(text) == want and enc.encode([text]) == [want]


def test_library_encoder_by_units(samples):
    lib = Tokenizer.from_file(BYTE)
    got = token_file.LibraryEncoder(BYTE).encode(samples)
    assert got == [np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in samples]


def test_pair_check_against_the_library():
    lib, enc, rng = Tokenizer.from_file(BYTE), bpe.BacktrackingEncoder(BYTE), random.Random(2)
    plain = [i for i, t in enumerate(enc.tokens) if t.isalpha() and t.isascii()]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        want = lib.encode((enc.tokens[a] + enc.tokens[b]).decode(), add_special_tokens=False).ids == [a, b]
        assert enc.compatible(a, b) == want


@pytest.mark.parametrize("high", [1, 3, 50257, 1 << 32])
@pytest.mark.parametrize("n", [1, 7, token_file.BLOCK, token_file.BLOCK + 1, 9000])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = high - 1
    body, starts = token_file.pack_blocks(ids, 95.0)
    assert (np.concatenate([token_file.unpack_block(body, s) for s in starts.tolist()]) == ids).all()


def test_outliers_are_patched():
    ids = np.array([5] * 1000 + [4_000_000_000] * 3, dtype=np.uint32)
    body, starts = token_file.pack_blocks(ids, 95.0)
    assert len(body) < 100 and (token_file.unpack_block(body, 0) == ids).all()


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (32, 4), (200, 50)])
def test_spliced_counts(samples, chunk, overlap):
    lib, counter, rng = Tokenizer.from_file(WORD), token_count.Counter(WORD, chunk, overlap), random.Random(chunk)
    texts = samples[:300] + ["".join(rng.choice(LETTERS + " " * k) for _ in range(rng.randint(100, 900))) for k in (0, 1, 3) for _ in range(60)]
    texts += ["a" * 500, "b" * 1000 + " c " * 200, "1" * 700, "x" * 300 + " " + "y" * 300 + "'s" * 100, " " * 900]
    assert counter.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_encode_documents(docs, no_docs, rows):
    lib = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, bpe.encode_documents(docs, BYTE, with_ids=False).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids, dtype="<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(no_docs, BYTE).count() == 0


def test_token_file(spark, docs, no_docs, rows, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    token_file.write_token_file(docs, BYTE, f"file://{tmp_path}/a")
    got = [tuple(r) for r in token_file.digest_token_file(spark, f"file://{tmp_path}/a").orderBy("start").collect()]
    start, want = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    token_file.write_token_file(no_docs, BYTE, f"file://{tmp_path}/b")
    assert token_file.read_token_file(spark, f"file://{tmp_path}/b").count() == 0


def test_count_tokens(docs, no_docs, rows):
    lib = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, token_count.count_tokens(docs, WORD).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert token_count.count_tokens(no_docs, WORD).count() == 0


def test_arrow_batches_are_bounded(spark):
    """An unset batch size becomes ``BATCH_BYTES``, and tasks get such batches; one that was set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    _common.ship(spark)
    assert spark.conf.get(name) == str(_common.BATCH_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text")
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 1.5 * _common.BATCH_BYTES
    try:
        spark.conf.set(name, "1000000")
        _common.ship(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)
