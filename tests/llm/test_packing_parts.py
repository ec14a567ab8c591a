"""Texts are cut into parts together: each different part is given to the model once, with the ids of the whole tokenizer."""

import random

import pyarrow as pa
import pytest

from shoreline.llm import packing, queries


@pytest.fixture(scope="module")
def whole():
    own = packing.WordTokenizer(queries.tokenizer_path())
    return lambda text: packing.array("I", own.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


def all_ids(texts, **kept):
    return list(packing.WordTokenizer(queries.tokenizer_path(), **kept).all_ids(texts))


def test_words_with_other_marks_are_not_cut_again(monkeypatch):
    cut, asked = packing.WordTokenizer.cut, []
    monkeypatch.setattr(packing.WordTokenizer, "cut", lambda self, p: asked.append(p) or cut(self, p))
    monkeypatch.setattr(packing.WordTokenizer, "__missing__", lambda self, word: pytest.fail(f"word by word: {word}"))
    texts = [f"{a}{word}{b}" for word in ("beach", "Beach", "BEACH", "Straße", "straße") for a in ("", "(", "\"") for b in ("", ",", "…", "'s", ")!")]
    all_ids(pa.array([" ".join(texts), *texts]))
    assert len(asked) == len(set(asked)) and {"beach", ",", "'s", ")!"} <= set(asked) and len(asked) < 12


def test_every_character_as_the_whole_tokenizer(whole):
    chars = [chr(c) for c in [*range(0x2B0), *range(0x2000, 0x2070), 0x301, 0x3A3, 0x2C65, 0x4E2D, 0x1F600]]
    texts = [t for c in chars for t in (c, c * 2, f"a{c}b", f"1{c}", f"{c}'s", f"'{c}", f"{c}A", f"don't {c}'LL're")]
    assert all_ids(pa.array(texts)) == [whole(t) for t in texts]


def test_suffixes_copies_nulls_and_odd_texts_as_the_whole_tokenizer(whole):
    rng = random.Random(3)
    texts = [None, "", "'", "s", "''s", "'s's", "'sun 're", "r e", "!'s", "'l", "l", "<|endoftext|>a", "<|ENDOFTEXT|>", "\n\n a  b\v", "x" * 300]
    for letters in ("aAsStTrReEvVmlLdD''' 1²ßé…’.,\n", "aAsS' 1İ́<|\x00Ж中 é"):
        texts += ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(4000)]
    texts += texts[:500]
    rng.shuffle(texts)
    assert all_ids(pa.array(texts), max_words=200) == [whole(t) for t in texts]
    assert all_ids(pa.array(texts).slice(777, 900)) == [whole(t) for t in texts[777:1677]]
    assert all_ids(pa.array([], pa.string())) == [] and all_ids(pa.array([None, ""], pa.string())) == [b"", b""]


def test_texts_are_cut_in_bounded_bytes(monkeypatch, whole):
    monkeypatch.setattr(packing, "TEXT_BYTES", 1000)
    plain_ids, sizes = packing.WordTokenizer.plain_ids, []
    monkeypatch.setattr(packing.WordTokenizer, "plain_ids", lambda self, some: sizes.append(sum(map(len, some.to_pylist()))) or plain_ids(self, some))
    texts = [f"word {i} " * (i % 40) for i in range(300)]
    assert all_ids(pa.array(texts)) == [whole(t) for t in texts]
    assert max(sizes) <= 1000 + max(map(len, texts)) and sum(sizes) == sum(map(len, texts))
