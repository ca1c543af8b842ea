"""BPE encoding and token files against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from intervale.llm import bpe, token_files
from tokenizers import Tokenizer

from .conftest import DOCS, rows


def test_bpe_equals_library(odd_docs, odd_texts, tokenizers):
    path = tokenizers("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_decode(odd_docs, path, block_chars=2000).collect()}
    digests = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(odd_docs, path)).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw, decoded = np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
        assert bytes(got[i].ids) == raw, text
        assert got[i].decoded == decoded, text
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_repeated_rows_and_shuffled_input(spark, tokenizers):
    docs = spark.createDataFrame(rows(["one two"] * 3) + rows(["one two"] * 2), DOCS).repartition(3, "source")
    got = bpe.digests(bpe.encode_decode(docs, tokenizers("word_bpe_49k.json"))).collect()
    assert sorted(r.doc_id for r in got) == [0, 0, 1, 1, 2]
    assert len({r.ids_sha256 for r in got}) == 1


def test_bpe_empty(no_docs, tokenizers):
    assert bpe.encode_decode(no_docs, tokenizers("word_bpe_49k.json")).count() == 0


def test_positions_round_trip():
    values = np.array([0, 1, 255, 256, 70_000, 2**31])
    assert (bpe._unpack(bpe._pack(values)) == values).all()
    assert len(bpe._unpack(bpe._pack(np.array([], int)))) == 0


def test_token_files_equal_library(odd_docs, odd_texts, tokenizers):
    path = tokenizers("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_files.digests(token_files.write_and_read(odd_docs, path)).collect()}
    start = 0
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)), text
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), text
        start += len(ids)


def test_encoder_on_corpus(spark, smallest, tokenizers):
    path = tokenizers("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), token_files.Encoder(open(path, encoding="utf-8").read())
    for r in spark.read.parquet(f"{smallest}/documents.parquet").limit(60).collect():
        assert encode(r.text) == np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files_order_repeats_and_empty(spark, no_docs, tokenizers):
    path = tokenizers("byte_bpe_50k.json")
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (None, "z"), (-3, "m"), (5, "a")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.write_and_read(docs, path).collect())
    assert [d for _, d, _ in got] == [None, -3, 5, 5, 5]
    assert [s for s, _, _ in got] == [0, 2, 4, 6, 8]
    assert token_files.write_and_read(no_docs, path).count() == 0


def test_frame_of_reference_round_trip():
    rng = np.random.default_rng(1)
    cases = [np.zeros(1, "<u4"), np.full(300, 7, "<u4"), rng.integers(0, 50_000, 1000).astype("<u4"), rng.integers(0, 2**32, 257, dtype=np.uint64).astype("<u4")]
    spiky = rng.integers(0, 16, 640).astype("<u4")
    spiky[::50] = 4_000_000_000
    for ids in [*cases, spiky]:
        doc_ids, sizes, back = token_files.unpack(token_files.pack([3, None], [len(ids) - 1, 1], ids))
        assert doc_ids == [3, None] and sizes.tolist() == [len(ids) - 1, 1] and (back == ids).all()
    assert len(token_files.pack([1], [640], spiky)) < 4 * 640 / 2


def test_encoder_on_random_texts(tokenizers):
    path = tokenizers("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), token_files.Encoder(open(path, encoding="utf-8").read())
    rng = random.Random(1)
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\0", "a", "b", "the", "'s", "'ll", "don't", "1", "23", "é", "日本", "Σ", "<|endoftext|>", ".", ",!", "_", "\x1c", "\x85", "\xa0", " \xa0", "\u2003", "😀", "e\u0301", "Ġ", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(20_000)] + [" \xa0 \xa0" * k for k in range(1, 9)]
    for size in (20_008, 7):
        for i in range(0, len(texts), size) if size > 100 else range(0, 700, size):
            part = texts[i : i + size]
            ids, n = encode.encode(pa.array(part))
            assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == library.encode(part[0], add_special_tokens=False).ids
            assert ids.tolist() == [x for e in library.encode_batch_fast(part, add_special_tokens=False) for x in e.ids]
            assert n.tolist() == [len(e.ids) for e in library.encode_batch_fast(part, add_special_tokens=False)]


def test_other_tokenizers_are_refused(odd_docs, tokenizers, tmp_path):
    made = json.load(open(tokenizers("byte_bpe_50k.json"), encoding="utf-8"))
    assert token_files.refusal(json.dumps(made)) is None
    assert token_files.refusal(open(tokenizers("word_bpe_49k.json"), encoding="utf-8").read())
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {**made["pre_tokenizer"], "add_prefix_space": True}), ("added_tokens", [{**made["added_tokens"][0], "lstrip": True}])):
        assert token_files.refusal(json.dumps({**made, key: value}))
    wide = {**made["model"], "vocab": made["model"]["vocab"] | {chr(0x120) * 2 + c: 60_000 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}}
    assert token_files.refusal(json.dumps({**made, "model": wide}))
    (tmp_path / "other.json").write_text(json.dumps({**made, "normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError, match="normalizes"):
        token_files.write(odd_docs, str(tmp_path / "other.json"), str(tmp_path / "out"))


def test_seeking_equals_a_full_read(spark, odd_docs, tokenizers, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write(odd_docs, tokenizers("byte_bpe_50k.json"), path, segment_ids=3000)
    whole = token_files.read(spark, path).collect()
    assert len({(r.shard, r.segment) for r in whole}) > 5
    rng, asked, want = random.Random(2), [], {}
    for r in whole:
        for lo, n in ((0, r.n_tokens), (k := rng.randrange(r.n_tokens), rng.randrange(r.n_tokens - k + 1))):
            asked.append((len(asked), r.shard, r.segment, r["at"] + lo, n))
            want[len(asked) - 1] = bytes(r.ids)[4 * lo : 4 * (lo + n)]
    got = token_files.fetch(spark, path, spark.createDataFrame(asked, "key long, shard int, segment int, at long, n long"))
    assert {r.key: bytes(r.ids) for r in got.collect()} == want


def test_bits_round_trip():
    rng = np.random.default_rng(3)
    for width in range(1, 33):
        values = rng.integers(0, 1 << width, (5, token_files.BLOCK))
        packed = token_files._pack_bits(values, width)
        assert packed.shape == (5, token_files.BLOCK * width // 8) and (token_files._unpack_bits(packed, width) == values).all()
        assert int.from_bytes(packed[0].tobytes(), "big") == sum(int(v) << (width * (token_files.BLOCK - 1 - i)) for i, v in enumerate(values[0]))
    assert token_files.bit_lengths(np.array([0, 1, 2, 3, 255, 256, 2**32 - 1])).tolist() == [0, 1, 2, 2, 8, 9, 32]


def test_rows_of_one_id_spread_over_tasks(spark, tokenizers):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    got = token_files.write_and_read(docs, tokenizers("byte_bpe_50k.json")).collect()
    assert len({r.shard for r in got}) > 1 and sorted(r.start for r in got)[-1] == sum(r.n_tokens for r in got) - sorted(got, key=lambda r: r.start)[-1].n_tokens
