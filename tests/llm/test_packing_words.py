"""Words that a packing worker keeps: few, whatever the texts hold, with the same ids."""

import random

from shoreline.llm import packing, queries


def test_kept_words_are_bounded_and_hot_ones_stay():
    rng = random.Random(4)
    own = packing.WordTokenizer(queries.tokenizer_path(), max_words=1000)
    hot = ["the", "Water,", "beach.", "straße"]
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    most = 0
    for i in range(200):
        words = [w for _ in range(20) for w in (word(), word().title() + "!", rng.choice(hot))] + ["x" * (200 + i), "Ab1" * 90]
        text = " ".join(words)
        assert own.ids(text) == packing.array("I", own.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        most = max(most, len(own) + len(own.older))
    assert most <= 1000 + 2 * 200  # and those of a text on either side
    assert all(len(w) <= packing.LONG_WORD for kept in (own, own.older) for w in kept)
    assert all(w in own or w in own.older for w in hot)


def test_default_keeps_fewer_words_than_took_too_much_memory():
    assert packing.WordTokenizer(queries.tokenizer_path()).max_words == packing.MAX_WORDS <= 300_000
