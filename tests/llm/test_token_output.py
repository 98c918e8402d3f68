import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weblens.llm.elias_fano import EliasFano
from weblens.llm.token_output import Encoder, TokenFile, _open, default_tokenizer, token_index, write_tokens


@given(st.lists(st.integers(0, 2**40), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = sorted(values)
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.uint64), (values[-1] + 1) if values else 1).to_bytes())
    assert code.values().tolist() == values
    for lo in range(0, len(values), 211):
        assert code.select_range(lo, min(len(values), lo + 700)).tolist() == values[lo : lo + 700]
    assert [code.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(EliasFano.of(ends, int(ends[-1]) + 1).to_bytes()) * 8 / len(ends) < 2.6 + np.log2(ends[-1] / len(ends))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


TRICKY = [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "don't stop. It's 3.14, ok?!", "x\ty", "é ñ ß, über.",
    "word,, next", "a b", "\0x y", "<|endoftext|> hi <|endoftext|>", "x<|endoftext|>y z", "日本 語。", "😀 ok", "a\r\nb", "one.\nTwo",
]


def same_as_library(encoder, plain, texts):
    for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string())).to_pylist(), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids + [0], repr(text)


def test_pieces_give_the_library_ids(encoder, plain):
    assert encoder.by_piece
    for text in TRICKY:
        same_as_library(encoder, plain, [text])
    same_as_library(encoder, plain, TRICKY)


@given(st.lists(st.text(alphabet=" \n\t.,!'aAéß1_-ñś　\x1cĠĊ", max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    same_as_library(*test_any_text.both, texts)


@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_characters(texts):
    same_as_library(*test_any_text.both, texts)


test_any_text.both = (Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer()))


def test_files_round_trip(spark, tmp_path, plain):
    rows = [(5, "b b"), (1, "a"), (None, None), (9, ""), (5, "b b"), (-3, "x\ny z"), (7, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, file int")
    folder = f"file://{tmp_path}/tokens"
    files = write_tokens(docs, folder)
    key = lambda r: (r[0] is not None, r[0] or 0)
    want, at = [], 0
    for i, t in sorted(rows, key=key):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    from weblens.llm.token_output import read_index

    got = [tuple(r)[:4] for r in read_index(files, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    fs, _ = _open(folder)
    spans = []
    for row in files.collect():
        file = TokenFile(fs, row["file"])
        spans += [tuple(file.ids(*file.span(k)).tolist()) for k in range(file.docs)]
    assert sorted(spans) == sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_index(docs, folder=f"file://{tmp_path}/none").collect() == []


def test_few_pieces_kept(plain, monkeypatch):
    monkeypatch.setattr("weblens.llm.token_output.KEPT_BYTES", 3000)
    monkeypatch.setattr("weblens.llm.token_output.GATHERED", 7)
    monkeypatch.setattr("weblens.llm.token_output.TOGETHER", 3)
    encoder = Encoder(default_tokenizer())
    for k in range(30):
        same_as_library(encoder, plain, [f"start w{k % 5} word{k} again, la\nend{k} la." for _ in range(3)])
        assert len(encoder.rows) < 60


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Encoder(path)
    assert not encoder.by_piece
    same_as_library(encoder, Tokenizer.from_file(path), ["One two.", "", "three  four\n"])


def test_a_repeated_id_has_several_files(spark, tmp_path, plain):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(token_index(docs, folder=f"file://{tmp_path}/many").collect(), key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in rows)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()
    crc = sorted(zlib.crc32(np.array(plain.encode(t).ids + [0], "<u4").tobytes()) for _, t in rows)
    assert sorted(r["ids_crc32"] for r in got) == crc
    assert len({r["file"] for r in got if r["doc_id"] == 7}) > 1
    assert len({r["file"] for r in got if r["doc_id"] is None}) > 1
