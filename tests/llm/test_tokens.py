"""op1, op5 and op10 against their libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS, docs_of
from touchline.llm import bpe_automaton, piece_counts, token_planes, word_cache
from touchline.llm.common import tokenizer_path

WORD, BYTE, PIECE = (tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = (
    "a b The ing tion 's 'll 'S 1 23 É é Å ́ 日本 <|endoftext|> <|ENDOFTEXT|> <|endof ! ... . , ). x. 5. ▁ ▁▁ <s> </s> <0x0A> ß İ ΑΣ 😀 aaaa ZZ".split(" ")
    + [" ", "  ", "\n", "\n \n", " \n", "\t", "\r", "\x00", "\x01", "\x02", "\x1c", "\x85", "\xa0", "　", "՘", "﻿"]
)


def spliced(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_piecewise_encoding_equals_the_library(monkeypatch):
    monkeypatch.setattr(word_cache, "MOST_PIECES", 2_000)  # generations change many times
    tokenizer, texts = library(WORD), spliced(6_000, 1) + ODD_TEXTS
    for text, ids in zip(texts, word_cache.encode_texts(WORD, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_capitals_beside_special_strings():
    text = "The ÉTÉ <|endoftext|> The. É"  # not lowered as a whole, since a special string is in it
    ids, = word_cache.PieceCache(WORD).ids([text])
    assert np.frombuffer(ids, "<u4").tolist() == library(WORD).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_undo(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (1, 2, 256, 49_408, 2**32):
            ids = rng.integers(0, top, n).astype("<u4")
            assert (token_planes.from_planes(token_planes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(spark, frame, tmp_path, kind):
    rows = docs_of(ODD_TEXTS + spliced(200, 2))
    rows = [(i if i % 7 else None, t, *rest) for i, t, *rest in rows] + rows[:5]  # NULL and repeated ids
    path = str(tmp_path / "planes")
    docs = frame(rows).withColumn("shard", F.lit("clash")).withColumn("ids", F.lit(1))
    token_planes.write_planes(docs.repartition(3), path, WORD, 1, kind=kind, block_ids=1_000)
    found = token_planes.read_documents(spark, path).collect()
    tokenizer = library(WORD)
    want = sorted((i is not None, i or 0, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in found)
    assert got == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    index = token_planes.block_index(spark, path)
    assert index.agg(F.sum("n_ids")).first()[0] == at and index.where("n_ids > 1000").count() == 0


def test_planes_of_nothing(spark, frame, tmp_path):
    token_planes.write_planes(frame([]), str(tmp_path / "none"), WORD, 1)
    assert token_planes.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_automaton_equals_the_library():
    tokenizer, codec = library(BYTE), bpe_automaton.codec(BYTE)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorst hT.'") for _ in range(rng.randint(0, 40))) for _ in range(6_000)]
    for text in spliced(6_000, 4) + words + [t for t in ODD_TEXTS if t is not None]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids, text
        assert codec.decode(codec.encode(text)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_automaton_words_split_as_the_library_does():
    codec, split = bpe_automaton.codec(BYTE), library(BYTE).pre_tokenizer.pre_tokenize_str
    for point in [*range(0x0, 0x700), 0x1680, 0x180E, *range(0x2000, 0x2100), 0x3000, 0x1F600]:
        text = f"a{chr(point)}b {chr(point)}"
        assert codec.words(text) == [text[i:j] for _, (i, j) in split(text)], hex(point)


@pytest.mark.parametrize("bits", [4, 20])
def test_runs_of_texts_equal_the_library(monkeypatch, bits):
    monkeypatch.setattr(bpe_automaton, "MOST", 500)  # generations change many times
    monkeypatch.setattr(bpe_automaton, "ANSWER_BITS", bits)  # many pairs share a place
    tokenizer, codec = library(BYTE), bpe_automaton.Codec(BYTE)
    rng = random.Random(9)
    blanks = [" ", "  ", "   ", "\n", " \n", "\n ", "\t ", "\x1c", "\xa0 ", " \x85", "\x1f "]
    words = [*"a b The É é ing 1 23 's 'll , . !! ). ½ ª µ".split(), "x,", "y.z", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choice(blanks if rng.random() < 0.5 else words) for _ in range(rng.randint(0, 12))) for _ in range(8_000)]
    run = pa.array([*texts, "", *[t for t in ODD_TEXTS if t is not None]])
    found = codec.encode_run(run)
    for text, ids in zip(run.to_pylist(), found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert codec.decode_run(found) == run.to_pylist()
    broken = [found[0][4:], np.array([codec.special.get("<|endoftext|>", 0), 200, 201], "<u4").tobytes(), b""]
    assert codec.decode_run(broken) == [tokenizer.decode(np.frombuffer(b, "<u4").tolist(), skip_special_tokens=False) for b in broken]


def test_only_new_pieces_are_encoded(monkeypatch):
    cache, asked = word_cache.PieceCache(WORD), []
    encode = cache._words
    monkeypatch.setattr(cache, "_words", lambda words: asked.extend(words) or encode(words))
    texts = ["The cat, the dog.", "the dog! The cat?"] * 500
    tokenizer = library(WORD)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:2]]
    assert cache.ids(texts) == want * 500 and sorted(asked) == ["cat", "dog", "the"]  # letters once, whatever signs follow


def test_gadgets_on_a_small_vocabulary():
    letters = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    automaton = bpe_automaton.Automaton(letters, [("a", "a"), ("a", "b"), ("aa", "b")])
    assert automaton.encode(b"aaa") == [2, 0] and automaton.encode(b"aab") == [4] and automaton.encode(b"aaab") == [2, 3]
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(letters, [("aa", "b")])


def test_automaton_columns(frame):
    docs = frame(docs_of(ODD_TEXTS)).withColumn("ids", F.lit("clash"))
    found = docs.select("doc_id", "text", bpe_automaton.encode("text", BYTE).alias("x")).select("*", bpe_automaton.decode("x", BYTE).alias("y")).collect()
    assert all(r["y"] == (r["text"] or "") for r in found) and len(found) == len(ODD_TEXTS)
    assert frame([]).select(bpe_automaton.encode("text", BYTE)).count() == 0


def test_piece_counts_equal_the_library():
    counter = piece_counts.piece_counter(PIECE)
    for text in spliced(12_000, 5) + [t for t in ODD_TEXTS if t is not None]:
        assert sum(counter.count(counter.pre_tokens(text))) == len(counter.model.encode(text)), text


@pytest.mark.parametrize("head", [0, 20, 250_000])
def test_piece_counts_by_document(frame, monkeypatch, head):
    monkeypatch.setattr(piece_counts, "HEAD", head)
    model = piece_counts.piece_counter(PIECE).model
    rows = docs_of(ODD_TEXTS + spliced(150, 6) * 2)
    rows += [(None, t, *rest) for _, t, *rest in rows[:20]] + rows[:20]
    docs = frame(rows).withColumn("n_bytes", F.lit("clash")).repartition(4)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in piece_counts.count_tokens(docs, PIECE).collect())
    assert got == sorted((i is not None, i or 0, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in rows)


def test_piece_counts_of_nothing(frame):
    assert piece_counts.count_tokens(frame([]), PIECE).count() == 0


def test_digest_of_the_query(spark):
    from touchline.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokenizer, start = library(WORD), 0
    for r in sorted(queries.op1_token_planes(spark, sf).collect(), key=lambda r: r["doc_id"]):
        ids = np.array(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
