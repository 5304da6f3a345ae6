"""Tokenisation, the token store, packing and SentencePiece against the libraries."""

import random
import struct
import time
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import packing, pieces, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a", " ", "\n\n  x", "it's 'S 12½ ²3 — ok…", "naïve\u00a0çà ñ", "日本語 text\x85", "<|endoftext|> <s>", "  lead and  trail  ", "a\u0301\u200b", "x" * 5000, "don't\t\r\nstop!!! ???"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aAé '.,12\n\t\r sS", max_size=60)))
def test_words_are_encoded_as_whole_texts(text):
    encoder = tokens.encoder(BPE)
    assert encoder(text) == encoder.whole(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| >", "日本 <|endoftext|>", *filter(None, ODD)])
def test_ids_are_those_of_the_untouched_library(text):
    wanted = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    assert array("I", tokens.encoder(BPE)(text)).tolist() == wanted


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_round_trip(gaps):
    values = np.cumsum([0, *gaps])
    data = tokens.elias_fano(values)
    read = tokens.EliasFano(data)
    assert (read.run(0, read.n) == values).all()
    for i in {0, len(values) // 2, len(values) - 1}:
        assert read.select(i) == values[i]
        assert (read.run(i, min(read.n, i + 300)) == values[i : i + 300]).all()
    assert len(data) <= 60 + len(values) * (2.2 + max(0, np.log2(values[-1] / len(values) + 1))) / 8 + len(values) / 16
    assert [read.first_at_least(x) for x in (0, int(values[-1]), int(values[-1]) + 1)] == [0, int(np.searchsorted(values, values[-1])), len(values)]


def rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(-5, "first"), (10_000, "")], "doc_id long, text string"))


def encoded(docs, end):
    encoder = tokens.encoder(BPE)
    got = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    return [(i, encoder.whole(t) + array("I", [end]).tobytes()) for i, t in got]


@pytest.mark.parametrize("options", [{}, {"shards": 3, "segment_ids": 700}])
def test_token_store(spark, folder, options):
    docs, at, wanted = rows(spark, folder), 0, []
    for i, ids in encoded(docs, 2):
        wanted.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    found = tokens.token_offsets(docs, BPE, 2, **options).collect()
    assert sorted(tuple(r) for r in found) == sorted(wanted)


def test_token_store_of_nothing_and_nulls(spark):
    docs = spark.createDataFrame([(None, "b"), (None, None), (4, "a")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.start) for r in tokens.token_offsets(docs, BPE, 2).collect()) == [("4", 3), ("None", 0), ("None", 1)]
    assert tokens.token_offsets(docs.limit(0), BPE, 2).count() == 0


def test_token_store_has_no_64_bit_tables(spark, folder, tmp_path):
    """Ids of documents and boundaries take some bits each; any document is found by select."""
    docs = rows(spark, folder)
    tokens.write_token_store(docs, str(tmp_path / "store"), BPE, 2, shards=2, segment_ids=20_000)
    store = spark.read.parquet(str(tmp_path / "store"))
    size = store.selectExpr("sum(n_docs) AS n", "count(*) AS m", "sum(length(doc_ids)) AS ids", "sum(length(boundaries)) AS bounds").first()
    assert size.m > 5 and size.ids < 0.6 * 8 * size.n and size.bounds < 0.6 * 8 * size.n
    want = {}
    for i, ids in encoded(docs, 2):
        want.setdefault(i, []).append(ids)
    asked = [-5, -4, 0, 3, 77, 10_000, 10_005, 999_999]
    found = sorted((r.doc_id, bytes(r.ids)) for r in tokens.lookup(store, asked).collect())
    assert found == sorted((i, ids) for i in asked for ids in want.get(i, []))


def test_token_store_of_extreme_ids_and_many_null_ones(spark, tmp_path):
    least, most = -(1 << 63), (1 << 63) - 1
    texts = [(None, f"text {i % 7}") for i in range(400)] + [(least, "low"), (most, "high"), (0, "x"), (0, "x"), (5, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, id int").withColumns({"digest": F.lit("a"), "split": F.lit(1)})
    out = sorted(tokens.token_offsets(docs.repartition(5), BPE, 2, shards=4).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None] * 400 + [least, 0, 0, 5, most]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))
    tokens.write_token_store(docs.repartition(5), str(tmp_path / "store"), BPE, 2, shards=4)
    nulls = spark.read.parquet(str(tmp_path / "store")).where("first_id IS NULL OR shard < 3").groupBy("shard").sum("n_docs").collect()
    assert len(nulls) >= 3 and max(r[1] for r in nulls) < 300


def plain_first_fit(lengths, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        bins += [0] * (b == len(bins))
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return out


@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    assert packing.first_fit_decreasing(lengths, 64) == plain_first_fit(lengths, 64)


def test_packing(spark, folder):
    docs = rows(spark, folder)
    found = packing.pack(docs, BPE, 0, capacity=1024, group_docs=64).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    wanted = {}
    for i, ids in encoded(docs, 0):
        wanted.setdefault(i, []).append(ids)
    assert set(by_doc) == set(wanted)
    for i, texts in wanted.items():
        want = sorted((s, min(4096, len(ids) - 4 * s) // 4, zlib.crc32(ids[4 * s : 4 * s + 4096]), len(ids) // 4) for ids in texts for s in range(0, len(ids) // 4, 1024))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]) == want
    lengths = {r.sequence_id: (r.tokens, r.padded) for r in packing.sequence_lengths(spark.createDataFrame(found, packing.PIECE)).collect()}
    padded = total = 0
    for name, sequence in by_sequence.items():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and lengths[name] == (at, at if at & (at - 1) == 0 else 1024)
        total += at
        padded += lengths[name][1]
    assert padded / total < 1.05


def test_packing_of_nothing_and_nulls(spark):
    docs = spark.createDataFrame([(None, None), (None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    found = packing.pack(docs, BPE, 0).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "None", "None"] and len({r.sequence_id for r in found}) == 1
    assert packing.pack(docs.limit(0), BPE, 0).count() == 0


def test_packing_of_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000), (2, "x" * 300_000), (3, "short")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("nr", "grp", "crcs", "length")})
    found = packing.pack(docs, BPE, 0).toPandas()
    of = found.groupby("doc_id")
    assert (of.length.sum() == of.doc_tokens.max()).all() and of.length.max().max() == 1024 and set(of.groups) == {1, 2, 3}


def test_pieces(spark, folder):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = rows(spark, folder)
    found = pieces.code_pieces(docs, PIECES, batch_chars=5000).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    assert len(found) == docs.count() and all(r.parity for r in found)
    for r in found[:: max(1, len(found) // 60)] + [r for r in found if r.doc_id >= 10_000]:
        ids = judge.encode(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == texts[r.doc_id] == judge.decode(ids) and r.round_trip


def test_pieces_tables(spark):
    """A null id, an empty table, a text far above a batch, and columns of any name."""
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, "word\u2581 é  " * 120_000), (2, "x" * 20_000)], "doc_id long, text string").withColumns({"ids": F.lit(1), "parity": F.lit("no")})
    out = pieces.code_pieces(docs, PIECES, batch_chars=1000).toPandas()
    assert out.parity.all() and sorted(out.n_pieces)[0] == 0 and out.doc_id.isna().sum() == 1 and out.n_pieces.max() > 400_000
    assert pieces.code_pieces(docs.limit(0), PIECES).count() == 0


def test_parts_come_and_go():
    """What is remembered is bounded, and forgetting changes nothing."""
    small, texts = pieces.PieceCoder(PIECES, remembered=50), [f"common words {i} and {i * 7919} {'y' * (i % 90)}\n\u4e2d" for i in range(300)]
    for i in range(0, 300, 10):
        ids, decoded, same = small.code_batch(texts[i : i + 10])
        assert all(same) and decoded == texts[i : i + 10] == small.decode_batch(ids)
    assert len(small.parts) + len(small.before) < 250 and max(map(len, small.parts)) <= pieces.LONGEST


def test_rare_parts_cost_less_than_parity():
    """Texts of words that are met once: coding them must not take longer than SentencePiece does for them."""
    draw = random.Random(7)
    texts = [" ".join("".join(draw.choices(["en", "st", "ti", "ou", "nd", "ha", "er"], k=4)) + str(draw.randrange(100)) if i % 8 == 0 else "the" for i in range(500)) for _ in range(300)]
    shares = []
    for _ in range(3):
        coder = pieces.PieceCoder(PIECES)
        began = time.process_time()
        coder.judge.encode(texts, num_threads=1, return_type="numpy")
        middle = time.process_time()
        ids, decoded, same = coder.code_batch(texts)
        shares.append((time.process_time() - middle) / (middle - began))  # the judge is asked once more in it
        assert all(same) and decoded == texts
    assert min(shares) < 2.25


@pytest.mark.parametrize("dummy_prefix", [0, 1])
def test_parts_without_a_dummy_prefix(tmp_path, dummy_prefix):
    """First words without a marker, runs of markers, bytes, and texts that read like pieces of bytes, by the cut and by SentencePiece."""
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    vocabulary += [(p, -float(i), 1) for i, p in enumerate(["ab", "▁a", "▁ab", "▁▁", "aba", "▁", "a", "b", "<", "0", "x", "4", "1", ">"])]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocabulary)
    body += message((2, message((3, 2), (35, 1), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))), (3, message((1, b"identity"), (3, dummy_prefix), (4, 0), (5, 1))))
    path = tmp_path / "small.model"
    path.write_bytes(body)
    coder = pieces.PieceCoder(str(path))
    assert coder.by_part and coder.marks_only and coder.model.kind == pieces.BPE
    texts = ["", "a", " ", "ab ab", " ab", "  ab  aba ", "a  ", "é ab", "abé é", "<0x41> <0x", "\nab\n", "ab" * 90 + " é" + "b" * 90]
    draw = random.Random(1)
    texts += ["".join(draw.choices("ab  é<0x41>", k=draw.randrange(1, 24))) for _ in range(300)]
    for _ in range(2):
        ids, decoded, same = coder.code_batch(texts)
        assert all(same) and [np.frombuffer(x, "<u4").tolist() for x in ids] == coder.judge.encode(texts)
        assert decoded == coder.decode_batch(ids) == texts
    assert max(map(len, coder.parts)) <= pieces.LONGEST and not coder.passing


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_pieces_of_any_text(text):
    text = text.replace("\x00", "")
    coder = pieces._coders.setdefault(PIECES, None) or pieces.PieceCoder(PIECES)
    pieces._coders[PIECES] = coder
    ids, same = coder.encode_batch([text])
    assert np.frombuffer(ids[0], "<u4").tolist() == coder.judge.encode(text) and same == [True]


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        else:
            out += varint(number << 3) + varint(value)
    return out


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_model_by_hand(tmp_path):
    """A protobuf written here: unigram scores, byte fallback, extra spaces removed."""
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    vocabulary += [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.5), ("▁a", -3.2), ("ab", -5.1), ("▁ab", -5.0), ("ba", -6.0), ("▁b", -5.5), ("abab", -9.0), ("c", -7.0)]]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocabulary)
    body += message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    path = tmp_path / "small.model"
    path.write_bytes(body)
    coder = pieces.PieceCoder(str(path))
    assert coder.model.kind == pieces.UNIGRAM and coder.model.byte_fallback
    random.seed(1)
    texts = ["", "ab ab", "  a   b ", "é b", "cab abab"] + ["".join(random.choices("abc  é", k=random.randrange(1, 20))) for _ in range(100)]
    ids, same = coder.encode_batch(texts)
    assert all(same)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == coder.judge.encode(texts)
    assert coder.decode_batch(ids) == [coder.judge.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
