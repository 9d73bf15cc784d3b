import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.common import new_path
from tidemark.llm.token_files import WordEncoder, encode_round_trip, pack, read_token_files, unpack, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=400))
def test_pack_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert unpack(pack(a), len(a)).tolist() == ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbÉéΣσ'sİK12 \t\n\x1c\x85 　.,!*<|>́", max_size=60))
def test_words_as_whole_texts(text):
    tok = Tokenizer.from_file(PATH)
    want = tok.encode(text, add_special_tokens=False).ids
    assert _enc.encode(pa.array([text, "b", text]))[0].tolist() == want + _B + want


_enc = WordEncoder(PATH)
_B = Tokenizer.from_file(PATH).encode("b").ids


def test_special_strings():
    for text in ("a <|endoftext|> b", "don't 'S x's 12ab..!", "<|x"):
        want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
        assert _enc.encode(pa.array([text, "b", text]))[0].tolist() == want + _B + want


def test_round_trip(spark):
    texts = ["Hello, world", None, "", "the the the", "the the the", "x " * 70000]
    docs = spark.createDataFrame([(7 * k % 11, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    rows = {r.doc_id: r for r in encode_round_trip(docs, PATH).collect()}
    tok, start = Tokenizer.from_file(PATH), 0
    for k, t in sorted((7 * k % 11, t) for k, t in enumerate(texts)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_and_null_keys(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_round_trip(docs, PATH).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c")], "doc_id long, text string")
    write_token_files(docs, path := new_path(spark, "t"), PATH, 2)
    rows = read_token_files(spark, path).orderBy("file", "position").collect()
    assert [r.key for r in rows] == [None, 3, 3] and all(r.ids[-1] == 2 for r in rows)
