"""Every stage of the pipeline against plain Python, each on what the stage before it kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from shoreline.llm import common, langid, packing, queries
from test_llm_operators import plain_classes, plain_simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage left, as lists of rows, beginning with all documents."""
    docs = common.table(spark, SF, "documents")
    junk = [(9000 + i, "".join(np.random.default_rng(i).choice(list("0123456789abcdef"), 1500)), None, "src0", 1500) for i in range(12)]
    docs = common.stored(docs.unionByName(spark.createDataFrame(junk, docs.schema)), "test")
    out = {"": [tuple(r) for r in docs.select(*COLUMNS).collect()]}
    for name, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, SF), "test")
        out[name] = [r if name == "best_fit_packing" else tuple(r) for r in docs.collect()]
    return out


# --- language identification

def plain_ppm(samples, order):
    """Counts of each byte after every context of up to ``order`` bytes."""
    counts = defaultdict(Counter)
    raw = b"\n" + b"\n".join(samples)
    for i in range(len(raw)):
        for k in range(order + 1):
            if i >= k:
                counts[raw[i - k:i]][raw[i]] += 1
    return counts


def plain_bits(counts, text, order, known):
    """Code length of ``text`` after a line break: escapes by method C, with exclusion."""
    bits, raw = 0.0, b"\n" + text
    for i in range(1, len(raw)):
        left, coded = None, False
        context = next(raw[i - k:i] for k in range(min(order, i), -1, -1) if raw[i - k:i] in known or not k)
        while True:
            seen = {b: n for b, n in counts[context].items() if left is None or b in left}
            total = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= np.log2(seen[raw[i]] / total)
                coded = True
                break
            if seen:
                bits -= np.log2(len(seen) / total)
                left = (set(range(256)) if left is None else left) - set(seen)
            if not context:
                break
            context = context[1:]
        if not coded:
            bits += np.log2(len(set(range(256)) if left is None else left))
    return bits


def test_code_lengths_equal_a_plain_ppm():
    rng = np.random.default_rng(1)
    samples = {"x": [b"abracadabra, the abbot", b"a cab"], "y": ["über öl und übel".encode(), b"hocus pocus"]}
    model = langid.train(samples, order=3, max_contexts=None)
    # all contexts that any language has seen are known, as in the shared table
    counts = {k: plain_ppm(v, 3) for k, v in samples.items()}
    known = {c for table in counts.values() for c in table if len(c) <= 3}
    texts = [b"abracadabra", "übel".encode(), b"zz top", b"a", bytes(rng.integers(0, 256, 60, dtype=np.uint8)), "the cab über pocus ".encode() * 5]
    got = langid.code_lengths(model, texts)
    for t, row in zip(texts, got):
        for name, bits in zip(model.langs, row):
            assert abs(plain_bits(counts[name], t, 3, known) - bits) < 1e-2, (t, name)


def test_language_stage(kept):
    before, after = kept[""], kept["language_id"]
    assert {r[0] for r in before} - {r[0] for r in after} >= set(range(9000, 9012))  # hex is of no language
    lost = [r for r in before if r[0] < 9000 and r[0] not in {a[0] for a in after}]
    assert len(lost) <= len(before) // 100
    by_id = {r[0]: r for r in before}
    for r in after:
        assert r[:2] == by_id[r[0]][:2] and (r[2] == by_id[r[0]][2] or by_id[r[0]][2] is None) and r[3:] == by_id[r[0]][3:]


def test_every_labelled_language_is_learned(spark):
    rng = np.random.default_rng(2)
    syllables = {"de": "ung sch ein der lich ver".split(), "en": "the ing tion and ough ly".split(), "es": "cion dad los que ado ella".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(["en", "es"] * 60)]
    rows += [(1000 + i, text("de", 90_000), "de") for i in range(8)]  # only texts far above the sample's bytes
    rows += [(2000 + i, text("de", 40), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(docs, sample_bytes=20_000).collect()}
    assert all(found[i]["lang_pred"] == (lang or "de") for i, _, lang in rows)
    chosen = langid.sample(docs, F.lit(True), 50, 20_000)
    assert set(chosen) == {"de", "en", "es"} and all(0 < sum(map(len, v)) <= 20_000 for v in chosen.values())
    assert all(len(t) <= 1100 for t in chosen["de"])


def test_slices_and_windows_do_not_change_the_scores(spark, monkeypatch):
    import pyarrow as pa

    docs = common.table(spark, SF, "documents").limit(60)
    texts = [r["text"] for r in docs.collect()] + [None, "", "12 34", "é" * 5000]
    model = langid.train({"en": [t.encode() for t in texts[:20] if t], "xx": [b"zzz yyy"]})
    whole = langid.judge_texts(model, pa.array(texts, pa.string()))
    for chunk in (64, 1000):
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        again = langid.judge_texts(model, pa.array(texts, pa.string()))
        assert again[0] == whole[0] and np.allclose(again[1], whole[1]) and np.allclose(again[2], whole[2])
    assert whole[0][-4:-1] == ["und"] * 3 and whole[2][-4:-1] == [0.0] * 3


def test_rate_bounds(spark):
    rows = [("a", 2.0 + i / 1000) for i in range(100)] + [("a", 3.0)] * 4 + [("b", 4.0)] * 3
    got = {r["lang"]: r["bound"] for r in langid.rate_bounds(spark.createDataFrame(rows, "lang string, rate double"), times=2.0).collect()}
    assert 2.09 < got["a"] < 2.4 and got["b"] >= 4.0  # few rows: the widest bound


# --- line deduplication

def test_line_stage(kept):
    before, after = kept["language_id"], kept["line_dedup"]
    lines = {r[0]: r[1].split("\n") for r in before}
    runs, lost = {}, defaultdict(set)
    for d in sorted(lines):
        x = lines[d]
        for s in range(len(x)):
            size = 0
            for e in range(s, len(x)):
                size += len(x[e])
                if size >= P.MIN_REPEATED_CHARS:
                    key = tuple(x[s:e + 1])
                    if runs.setdefault(key, (d, s)) != (d, s):
                        lost[d].update(range(s, e + 1))
                    if e - s > 30:
                        break
    expect = {}
    for d, x in lines.items():
        text = "\n".join(line for i, line in enumerate(x) if i not in lost[d])
        if not lost[d] or words(text):
            expect[d] = text
    assert {r[0]: r[1] for r in after} == expect and any(lost.values())
    assert all(r[4] == (len(r[1]) if lost[r[0]] else dict((b[0], b[4]) for b in before)[r[0]]) for r in after)


# --- near duplicates

def test_near_duplicate_stage(kept):
    before, after = kept["line_dedup"], kept["simhash_near_dedup"]
    classes = plain_classes([(r[0], plain_simhash(r[1], 4)) for r in before], 4)
    assert Counter(after) == Counter(r for r, c in zip(before, classes) if r[0] == c)


# --- mixing

def test_mixing_stage(kept):
    before, after = kept["simhash_near_dedup"], kept["mix_sources"]
    taken, known = Counter(after), set(before)
    assert set(taken) <= known and max(taken.values()) <= 2
    size, sources = Counter(), sorted({r[3] for r in before}, key=lambda s: (s is None, s))
    for r in before:
        size[r[3]] += len(words(r[1]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    got = Counter()
    for r, n in taken.items():
        got[r[3]] += n * len(words(r[1]))
    longest = {s: max(len(words(r[1])) for r in before if r[3] == s) for s in sources}
    for s in sources:  # a source of few documents can only be met to half a document
        assert abs(got[s] - target[s]) <= max(0.02 * target[s], longest[s] / 2), (s, got[s], target[s])


# --- packing

def test_packing_stage(kept):
    before, after = kept["mix_sources"], kept["best_fit_packing"]
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expect = Counter()
    for r in before:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), P.CAPACITY)):
            part = np.array(ids[at:at + P.CAPACITY], "<u4").tobytes()
            expect[(r[0], k, at, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == expect
    rooms = defaultdict(list)
    for r in after:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rooms.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= P.CAPACITY
    assert len(rooms) <= -(-sum(r["length"] for r in after) // P.CAPACITY) + 2


def test_run_is_the_stages_in_turn(spark):
    rows = P.run(spark, SF).select("doc_id", "piece", "length").collect()
    docs = common.table(spark, SF, "documents")
    for _, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, SF), "test")
    assert Counter(map(tuple, rows)) == Counter(map(tuple, docs.select("doc_id", "piece", "length").collect()))


# --- packing plans

def lengths(seed, n=4000):
    rng = np.random.default_rng(seed)
    return np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patterns_place_most_pieces_and_fill_sequences(seed):
    counts = np.bincount(lengths(seed), minlength=2049)
    plan = packing.planned(counts, 2048)
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert plan.pieces == 4000 and plan.by_patterns > 0.5 * plan.pieces
    alone = packing.fill(counts, 2048, {}, [], np.zeros(0))
    assert alone.by_patterns == 0 and plan.sequences <= min(alone.sequences, bound) + 1


def test_whole_repeats_keep_their_sum():
    x = np.array([0.5, 0.5, 1.4, 2.6, 0.0])
    assert packing.whole_repeats(x).sum() == 5 and packing.whole_repeats(x)[3] == 3 and packing.whole_repeats(x)[4] == 0


def test_words_in_one_part_are_those_of_the_whole_tokenizer():
    own = packing.WordTokenizer(queries.tokenizer_path())
    for t in ("Hello WORLD", "don't Stop", "IBM's x2y", "naïve Éa ÀÖ", "a" * 300, "<|endoftext|> x", "İstanbul", "zz\x00zz"):
        assert own.ids(t) == np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
