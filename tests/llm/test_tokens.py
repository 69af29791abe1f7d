import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCUMENTS, SF_DIR, awkward_rows
from tokenizers import Tokenizer

from harvestline.llm.queries import word_tokenizer
from harvestline.llm.token_counts import count_tokens, frequent_keys
from harvestline.llm.token_files import COUNTS, WIDTHS, decode_block, encode_block, read_digests, write_token_files
from harvestline.llm.tokenizer import Generations, encoder, id_cache

PATH = word_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own_ids(text):
    packed = b"".join(map(id_cache(PATH).__getitem__, encoder(PATH).keys(text)))
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    assert own_ids(text) == library_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAzZ'sStTlL éÉßñ12²½.,!-_ \n\t\x0b\xa0<|>İḰ", max_size=60))
def test_awkward_letters_as_the_library(text):
    assert own_ids(text) == library_ids(text)


def test_each_character_as_the_library():
    for code in [*range(0x1, 0x600), *range(0x1E00, 0x2100), 0xFB01, 0x1F600, 0x3042]:
        assert own_ids(chr(code)) == library_ids(chr(code)), hex(code)


def test_added_tokens_inside_texts():
    for text in ("<|endoftext|>", "a<|endoftext|>b", "<|startoftext|> x <|EndOfText|>", "<| endoftext |>"):
        assert own_ids(text) == library_ids(text)


def test_another_tokenizer_is_left_to_the_library():
    path = PATH.replace("word_bpe_49k", "byte_bpe_50k")
    other = Tokenizer.from_file(path)
    text = "Hello, World's  café\n\n"
    packed = b"".join(map(encoder(path).ids, encoder(path).keys(text)))
    assert np.frombuffer(packed, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded():
    made = []
    memory = Generations(lambda k: made.append(k) or k, 10, {"pinned": "pinned"})
    for i in range(100):
        assert memory[f"k{i}"] == f"k{i}"
        assert memory["pinned"] == "pinned"
    assert len(memory) + len(memory.older) <= 14
    assert "pinned" not in made


def test_long_pre_tokens_are_not_remembered():
    memory = Generations(len, 1000)
    assert memory["x" * 5000] == 5000 and memory["x" * 64] == 64
    assert list(memory) == ["x" * 64]


@pytest.mark.parametrize("path", [PATH, PATH.replace("word_bpe_49k", "byte_bpe_50k")])
def test_texts_without_spaces_send_no_long_keys_to_the_driver(spark, path):
    texts = ["".join(chr(0x4E00 + (i * 7 + j * j) % 3000) for j in range(2000)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "zh", "a", 1) for i, t in enumerate(texts + ["short words", "short"])], DOCUMENTS)
    assert all(len(key) <= 64 for key in frequent_keys(docs, path))
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, path).collect()}
    assert got[40] == len(library.encode("short words", add_special_tokens=False).ids)
    assert got[3] == len(library.encode(texts[3], add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 49_407), st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=300))
def test_blocks_round_trip(values):
    assert decode_block(encode_block(np.array(values, np.uint64))).tolist() == values


def test_words_pack_greedily():
    values = (np.random.default_rng(5).integers(0, 2**62, 3000) >> np.random.default_rng(6).integers(0, 62, 3000)).tolist()
    words = np.frombuffer(data := encode_block(np.array(values, np.uint64)), "<u8", np.frombuffer(data, "<u4", 4)[2], 16)
    want, i = [], 0
    while i < len(values):
        fits = [
            s for s in range(14) if i + COUNTS[s] <= len(values) and all(v.bit_length() <= WIDTHS[s] for v in values[i : i + COUNTS[s]])
        ]
        want.append(fits[0] if fits else 15)
        i += COUNTS[want[-1]]
    assert (words >> np.uint64(60)).tolist() == want


def expected_files(rows):
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library_ids(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, tmp_path):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS shard", "2 AS data").repartition(4)
    write_token_files(docs, str(tmp_path / "ids"), PATH, shards=3)
    got = sorted(map(tuple, read_digests(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    assert got == expected_files(rows)


def test_files_of_nothing(spark, tmp_path):
    write_token_files(spark.createDataFrame([], DOCUMENTS), str(tmp_path / "ids"), PATH)
    assert read_digests(spark, str(tmp_path / "ids")).collect() == []


@pytest.mark.parametrize("frequent", [0, 50, 65_536])
def test_counts(spark, frequent):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS n_tokens", "2 AS keys").repartition(3)
    got = sorted(map(tuple, count_tokens(docs, PATH, 20, frequent).collect()), key=repr)
    want = [(d, len((t or "").encode()), n := len(library_ids(t)), n > 20) for d, t, *_ in rows]
    assert got == sorted(want, key=repr)


def test_counts_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = sorted((r["doc_id"], len(library_ids(r["text"]))) for r in docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(docs, PATH).collect()) == want


def test_counts_of_nothing(spark):
    assert count_tokens(spark.createDataFrame([], DOCUMENTS), PATH).collect() == []


def test_summaries_of_many_tasks_merge_level_by_level(spark):
    rows = [(i, f"common words {i}", "en", "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(40)
    assert set(frequent_keys(docs, PATH, 2)) == {"common", "words"}
    want = sorted((i, len(library_ids(t))) for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(docs, PATH, 20, 2).collect()) == want
