import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "ΑΣ ΣΑΣ", "İstanbul", "a<|endoftext|>B <|startoftext|>", "<|endoftext", "it's DON'T we'll 'S", "日本語 テスト 😀😀 \x00\x1f", "x" * 5000, "١٢٣ ½ Ⅷ", "é́ ﬁ", "a　c\x85d\x1ce", "ǅ ß ẞ"]


def test_encodes_and_decodes_as_the_library(spark, docs, rows):
    lib = Tokenizer.from_file(PATH)
    out = bpe.encode_documents(docs, PATH, decoded_col="decoded").collect()
    assert len(out) == len(rows)
    for r in out:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want
        assert r.decoded == lib.decode(want, skip_special_tokens=False)


def test_odd_texts():
    lib, own = Tokenizer.from_file(PATH), bpe.WordBPE(PATH)
    for text in ODD:
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert own.decode(own.encode(text)) == lib.decode(want, skip_special_tokens=False)


def test_cuts_are_certain():
    own = bpe.WordBPE(PATH)
    for word in ("zqxjk", "hello", "thblentio", "é" * 9):
        whole = own.merge(tuple(own.coded(word)))
        assert np.frombuffer(own.word(word), "<u4").tolist() == list(whole)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    own, fresh = bpe.WordBPE(PATH), bpe.WordBPE(PATH)
    for k in range(100):
        assert own.word(f"word{k}x") == fresh._word(f"word{k}x")
    assert len(own.words) <= 10 and len(own.older) <= 10


def test_empty_table_and_other_columns(none):
    out = bpe.encode_documents(none, PATH)
    assert out.count() == 0 and out.columns == [*none.columns, "token_ids"]


def test_long_words_of_equal_and_mixed_letters():
    lib, own = Tokenizer.from_file(PATH), bpe.WordBPE(PATH)
    rnd = random.Random(3)
    for text in ("a" * 3001, "ab" * 999, "".join(rnd.choice("etaoin") for _ in range(4000)), "tionthe" * 400):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        # both ways of merging agree
        assert own._merged(own.coded(text)) == own._merged_long(own.coded(text))


def test_a_word_of_a_million_letters_takes_seconds():
    own = bpe.WordBPE(PATH)
    start = time.perf_counter()
    ids = np.frombuffer(own.encode("a" * 1_000_000), "<u4")
    assert time.perf_counter() - start < 30 and own.decode(ids.tobytes()).replace(" ", "").replace(own.end, "") == "a" * 1_000_000
