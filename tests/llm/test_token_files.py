"""Token files: exact round trips, blocks on their own, damage, ids equal to the library's."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furlong.llm import context_mixing, token_files
from furlong.llm.token_files import TextEncoder, TokenFile, decode_files, encode_files, pack_file, read_ids

MODEL = token_files.read_tokenizer(token_files.tokenizer_path())
ENCODER = TextEncoder(MODEL)
DOCS = "doc_id bigint, text string, lang string, source string, start int, file string, row int, n int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(MODEL)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 5), max_size=400), st.integers(1, 64))
def test_round_trip_of_any_ids(ids, block):
    data = pack_file([1], [len(ids)], np.array(ids, dtype="<u4"), block)
    found = TokenFile(data)
    assert found.ids().tolist() == ids
    for k in range(-(-len(ids) // block)):  # each block on its own
        assert found.ids(k, k + 1).tolist() == ids[k * block : (k + 1) * block]


def test_large_alphabets_and_predictable_blocks():
    rng = np.random.default_rng(1)
    ids = rng.permutation(400_000).astype("<u4")
    assert (TokenFile(pack_file([1], [len(ids)], ids, 512)).ids() == ids).all()
    phrase = rng.integers(0, 50_000, 40).astype("<u4")
    data = pack_file([1], [40 * 2000], np.tile(phrase, 2000), 2048)
    assert (TokenFile(data).ids() == np.tile(phrase, 2000)).all()
    assert len(data) < 40 * 2000 * 4 / 20  # what repeats is learned in every block


def test_the_mix_beats_order_zero():
    rng = np.random.default_rng(2)
    follows = rng.integers(0, 300, (300, 3))
    ids = [0, 1]
    for k in rng.integers(0, 3, 60_000):
        ids.append(int(follows[ids[-1], k]))
    ids = np.array(ids, dtype="<u4")
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * len(pack_file([1], [len(ids)], ids, 4096)) < 0.8 * len(ids) * -(p * np.log2(p)).sum()


def test_damage_is_found():
    ids = np.arange(5000, dtype="<u4") % 77
    data = bytearray(pack_file([3, None], [2000, 3000], ids, 1000))
    with pytest.raises(ValueError, match="not a token file"):
        TokenFile(b"x" + bytes(data))
    broken = bytearray(data)
    broken[20] ^= 1
    with pytest.raises(ValueError, match="header"):
        TokenFile(bytes(broken))
    found = TokenFile(bytes(data))
    assert found.docs == [3, None] and found.counts.tolist() == [2000, 3000]
    broken = bytearray(data)
    broken[len(data) - len(found.body) + int(found.at[2])] ^= 1
    hurt = TokenFile(bytes(broken))
    with pytest.raises(ValueError, match="block 2"):
        hurt.ids()
    assert hurt.ids(3, 5).tolist() == ids[3000:].tolist()


def test_carries_run_through_full_digits():
    coder = context_mixing.Encoder(1)
    coder.lane, coder.digit = [np.zeros(4, dtype=np.int64)], [np.array([7, 65535, 65535, 65536])]
    digits, counts = coder.finish()
    assert digits.tolist() == [8, 0, 0, 0, 0, 0] and counts.tolist() == [6]


texts = st.text(st.sampled_from(list("ab1.,'s \n\t \u0085\x1c é日<|>")) | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_ids_are_those_of_the_library(some):
    some = [*some, "it's <|endoftext|> x", "a  b", " a b ", "a \n b"]
    assert ENCODER.by_word
    want = [ENCODER.library.encode(t, add_special_tokens=False).ids for t in some]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.many(some)] == want


def corpus():
    rng = random.Random(4)
    bag = ["the", "été", "日本", "don't", "x1", "\n", "  ", "<|endoftext|>", "😀", "word"]
    rows = [(k * 7 % 500 - 20, " ".join(rng.choices(bag, k=rng.choice([0, 1, 9, 200]))), "en", "s", 1, "f", 2, 3) for k in range(300)]
    rows += [(None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(11, None, "en", "s", 1, "f", 2, 3), (12, "", "en", "s", 1, "f", 2, 3), (13, "copy", "en", "s", 1, "f", 2, 3)]
    rows += [(13, "copy", "en", "s", 1, "f", 2, 3)] * 150  # one id holds a third of all rows
    rows.append((14, "long text " * 40_000 + "x" * 100_000, "en", "s", 1, "f", 2, 3))
    return rows


@pytest.mark.parametrize(("block", "file_tokens"), [(2048, 1 << 23), (16, 1000)])
def test_documents_come_back_in_order(spark, library, block, file_tokens):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    folder = encode_files(docs, MODEL, block_tokens=block, file_tokens=file_tokens)
    got = decode_files(spark, folder).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    back = {r.doc_id: r.ids for r in read_ids(spark, folder).filter("doc_id between 0 and 10").collect()}
    text_of = {r[0]: r[1] for r in rows}
    assert back and all(v == [*library.encode(text_of[k], add_special_tokens=False).ids, 2] for k, v in back.items())


def test_empty_table(spark):
    folder = encode_files(spark.createDataFrame([], DOCS), MODEL)
    assert decode_files(spark, folder).collect() == []
