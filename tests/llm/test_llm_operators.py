"""The training-data operators on small fixtures: brute force, round trips, edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoreline.llm import ann, common, langid, linededup, mixing, packing, pii, quality, queries, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, "
CLASH = ["fp", "component_id", "_kept", "_rows", "_at", "_id", "_h", "_mask", "_lines", "_lost", "_source", "_size", "_copies",
         "_words", "_each", "col", "lang_pred", "score", "_text", "size", "shard", "length", "_index", "a.b"]
LONG = "palabra " * 30_000
ROWS = [
    (0, "One fine line that stands in more than one document, and is rather long.\nA second line.", "en", "a"),
    (1, "Other words.\nOne fine line that stands in more than one document, and is rather long.", "en", "a"),
    (2, None, None, None), (3, "", "en", "b"), (4, " \t\n ", "en", "b"), (5, "1234 %% 99", None, "b"),
    (6, LONG, "es", "c"), (7, LONG, "es", "c"), (7, LONG, "es", "c"),
    (None, "no id has this text of several words", "en", None), (None, "no id has this text of several words", "en", None),
    (9, "ünïcode wörter für die ganze welt, und noch mehr davon", "de", "a"), (10, "x", "en", "a"),
]


def frame(spark, rows, clash=True):
    extra = [(c, "string") for c in CLASH] if clash else []
    schema = SCHEMA + ", ".join(f"`{c}` {t}" for c, t in extra) if extra else SCHEMA.rstrip(", ")
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(extra)) for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, ROWS).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- SimHash

def plain_simhash(text, k):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(items, radius):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(items))]


def same_classes(found, items):
    expect = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(items, plain_classes(items, 4))), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found.collect()), key=str) == expect


def test_simhash_against_brute_force(spark, texts):
    same_classes(queries.op1_simhash_near_dedup(spark, SF), [(d, plain_simhash(r["text"], 4)) for d, r in texts.items()])


def test_simhash_odd_rows(odd, none):
    same_classes(simhash.near_duplicates(odd, blocks=4), [(r[0], plain_simhash(r[1], 4)) for r in ROWS])
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(odd, blocks=4)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([0, 1, 2, 5, 6, None, 9, 10])


def test_one_document_of_each_class_stays_whatever_its_id(spark):
    rng = np.random.default_rng(8)
    a, b, c, d, e = (" ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (None, c), (8, d), (8, e), (5, a + " x"), (3, d), (5, e), (2, b + " "), (2, c)]
    kept = simhash.keep_one(frame(spark, [(i, t, "en", "s") for i, t in rows]), radius=0, blocks=4)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(None, a), (2, b + " "), (2, c), (3, d), (5, e), (5, a + " x")])


def test_links_span_dense_groups_and_chains():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 64, (30, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    expect = plain_classes([(i, int(x)) for i, x in enumerate(fps)], 4)
    u, v = simhash.links(fps, None, 4)
    half = simhash.links(fps[::2], fps[1::2], 4), simhash.links(fps[::2], None, 4), simhash.links(fps[1::2], None, 4)
    for pairs in ([(u, v)], half):
        root = {int(x): int(x) for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            assert len(a) < len(fps)
            for x, y in zip(a.tolist(), b.tolist()):
                root[find(x)] = find(y)
        groups = {}
        for x, c in zip(fps.tolist(), expect):
            groups.setdefault(find(x), set()).add(c)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expect))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(12)] + [(1000, x) for x in range(900, 960)] + [(5, 5), (7, 6)]
    got = {r["u"]: r["v"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 13)}, **{x: 900 for x in [*range(901, 960), 1000]}}


# --- language identification

def test_ppm_code_lengths_are_a_code_and_independent_of_chunks(monkeypatch):
    model = langid.train({"x": [b"abracadabra abracadabra"], "y": [b"hocus pocus hocus pocus"]}, order=3)
    width = int(model.byte_class.max()) + 1
    prob = np.exp2(-model.bits.astype(float)).reshape(-1, width, 2)
    whole = prob[:, 1:].sum(axis=1) + prob[:, 0] * (256 - width + 1)  # class 0 stands for every unseen byte
    assert np.allclose(whole, 1, atol=1e-5)
    items = [b"abracadabra hocus", b"", b"zz\xff", b"pocus " * 50]
    full = langid.code_lengths(model, items)
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert np.allclose(full, langid.code_lengths(model, items))
    alone = np.concatenate([langid.code_lengths(model, [t]) for t in items])
    assert np.allclose(full, alone)
    # by hand: after a newline nothing but the first byte was seen
    assert (full[0] > 0).all() and full[1].sum() == 0


def test_language_accuracy_on_held_out_documents(spark, texts):
    rows = queries.op2_language_id(spark, SF).collect()
    assert len(rows) == len(texts)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in texts if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = dict((x[0], x[1]) for x in ROWS)[r["doc_id"]]
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "es", "de")
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not {2, 3, 4, 5} & {r["doc_id"] for r in kept.collect()}


# --- sharding

def check_shards(rows, source, shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in source), key=str)
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["law"] for r in rows} <= {"bytes"} and all(r["grown_shard"] is None for r in rows)


def test_sharding(spark, docs, texts, odd, none):
    rows = queries.op3_sharding(spark, SF).collect()
    check_shards(rows, [(d, r["text"]) for d, r in texts.items()], 40)
    few = sharding.shard_by_bytes(docs, shards=4).collect()
    loads = [sum(r["size"] for r in few if r["shard"] == s) for s in range(4)]
    assert max(loads) < 1.1 * sum(loads) / 4 and min(loads) > 0.9 * sum(loads) / 4
    homes = {}
    for r in few:
        homes.setdefault(texts[r["doc_id"]]["text"], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    check_shards(sharding.shard_by_bytes(odd, shards=3).collect(), [(r[0], r[1]) for r in ROWS], 3)
    assert sharding.shard_by_bytes(none, shards=3).count() == 0


def test_an_overfull_group_is_divided(spark):
    rows = [(i, "the same text" if i < 600 else f"text number {i} of many", "en", "a") for i in range(1800)]
    got = sharding.shard_by_bytes(frame(spark, rows, clash=False), shards=10).collect()
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.15 * sum(loads.values()) / 10 and len(loads) == 10


# --- WARC

def test_warc_round_trip(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in common.table(spark, SF, "pages").collect()}
    rows = queries.op4_warc(spark, SF).collect()
    first = {}
    for p in sorted(pages):
        if len(pages[p]) >= 100:
            first.setdefault(pages[p], p)
    expect = []
    for p, body in pages.items():
        again = first.get(body, p) != p
        expect.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    assert sorted(map(tuple, rows)) == sorted(expect)


def test_warc_odd_records_and_pushdown(spark, tmp_dir):
    body = b"p" * 5000 + b"\r\n\r\n"
    rows = [("response", "<urn:a>", "d", "http://x/%41\nü", "sha256:1", None, 5004, bytearray(body)),
            ("response", "<urn:b>", None, None, None, None, None, None),
            ("revisit", "<urn:c>", "d", "http://y", "sha256:1", "<urn:a>", 5004, None)]
    df = spark.createDataFrame(rows, warc.SCHEMA)
    path = f"{tmp_dir}/archive"
    warc.write(df.repartition(2), path)
    got = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert bytes(got["<urn:a>"]["payload"]) == body and got["<urn:a>"]["target_uri"] == "http://x/%41\nü"
    assert bytes(got["<urn:b>"]["payload"]) == b"" and got["<urn:b>"]["target_uri"] is None
    assert got["<urn:c>"]["refers_to"] == "<urn:a>"
    only = warc.read(spark, path).filter("record_type = 'revisit' and payload_bytes > 10").collect()
    assert [r["record_id"] for r in only] == ["<urn:c>"]
    assert [r["record_id"] for r in warc.read(spark, path, ["record_id"]).filter("record_id in ('<urn:b>', 'z')").collect()] == ["<urn:b>"]
    warc.write(df.limit(0), f"{tmp_dir}/empty")
    assert warc.read(spark, f"{tmp_dir}/empty").count() == 0


def test_unwanted_payloads_are_not_decoded(tmp_path):
    import gzip

    import pyarrow as pa

    raw = b"".join(warc.encode({"record_type": t, "record_id": str(i), "payload": bytes(np.random.default_rng(i).bytes(200_000))})
                   for i, t in enumerate(["response", "metadata", "response"]))
    assert len(gzip.decompress(raw)) > 600_000  # plain gzip readers take it
    broken = bytearray(raw)
    cut = warc._extra_length(raw[:64])
    broken[cut + 100_000:cut + 100_400] = b"\0" * 400  # damage the payload of the unwanted record
    got = list(warc.records(pa.PythonFile(__import__("io").BytesIO(bytes(broken)), "r"), lambda h: h["warc-type"] == "response", True))
    assert [h["warc-record-id"] for h, _ in got] == ["0", "2"] and all(len(p) == 200_000 for _, p in got)
    # archives of other writers have no length in the extra field
    plain = b"".join(gzip.compress(gzip.decompress(warc.encode({"record_type": "response", "record_id": str(i), "payload": b"q" * 9000}))) for i in range(3))
    got = list(warc.records(pa.PythonFile(__import__("io").BytesIO(plain), "r"), lambda h: h["warc-record-id"] != "1", True))
    assert [(h["warc-record-id"], len(p)) for h, p in got] == [("0", 9000), ("2", 9000)]


def test_page_ids_that_are_missing_or_repeat(spark, tmp_dir):
    body = "z" * 200
    pages = spark.createDataFrame([(5, "u", body), (5, "u", body), (9, "v", body), (None, "w", body), (None, None, "q" * 200), (7, None, None)],
                                  "page_id long, url string, html string")
    warc.write(warc.page_records(pages), f"{tmp_dir}/p")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.page_digests(spark, f"{tmp_dir}/p").collect()), key=str)
    assert got == sorted([(5, "response", None, 200), (5, "response", None, 200), (9, "revisit", 5, 200), (None, "revisit", 5, 200),
                          (None, "response", None, 200), (7, "response", None, 0)], key=str)


# --- line dedup

def plain_line_dedup(rows, least):
    """Every run of at least ``least`` characters with an earlier copy loses its lines: brute force
    over maximal matches of all pairs of positions."""
    order = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    lines = [t.split("\n") for *_, t in order]
    at = [(i, k) for i, x in enumerate(lines) for k in range(len(x))]
    lost = set()
    for n, (i, k) in enumerate(at):
        for j, m in at[:n]:
            size = 0
            while k + size < len(lines[i]) and m + size < len(lines[j]) and lines[i][k + size] == lines[j][m + size]:
                size += 1
            if sum(map(len, lines[i][k:k + size])) >= least:
                lost |= {(i, k + s) for s in range(size)}
    return {key: "\n".join(x for k, x in enumerate(lines[i]) if (i, k) not in lost) for i, key in enumerate(order)}


def check_lines(spark, rows, least):
    got = linededup.dedup_lines(frame(spark, [(d, t, "en", "a") for d, t in rows]), least).collect()
    expect = plain_line_dedup(rows, least)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(
        ((d, None if t is None else expect[d is None, d or 0, t]) for d, t in rows), key=str)


def test_line_dedup_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), "\n".join("x" * int(n) for n in rng.integers(0, 5, int(rng.integers(1, 14))))) for i in range(40)]
    check_lines(spark, rows, 9)
    check_lines(spark, [(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (5, "abcdefghij\n" * 40), (6, "k\nabcdefghij\n\nabcdefghij"),
                        (6, "k\nabcdefghij\n\nabcdefghij"), (None, "abcdefghij")], 10)


def test_line_dedup_edges(spark, odd, none):
    rows = {(r["doc_id"], r["text"]): r for r in linededup.dedup_lines(odd).collect()}
    assert rows[1, "Other words."]["_lines_1"] == 2 and rows[1, "Other words."]["_lost_1"] == 1
    kept = linededup.drop_repeated_lines(odd)
    assert kept.columns == odd.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got[7] == 0 and got[6] == 1 and got[2] == got[3] == got[4] == 1  # copies go, empty ones were so before
    assert kept.filter("doc_id = 1").first()["n_chars"] == len("Other words.")
    assert linededup.dedup_lines(none).count() == 0


# --- PII

PII = [
    (0, "mail a.b@c.de, a@b a@b.c@d.e +1 (736) 555-2678 end"), (1, "ip 10.0.0.1 999.1.1.1 1.2.3.4.5 007.1.1.1"),
    (2, "card 4111 1111 1111 1111, 4111111111111112; 4111-1111-1111-1111-"), (3, "é 4111111111111111 +49 30 123456 \U0001f600 x@y.zz"),
    (4, None), (5, ""), (6, "+1234567890123456 +12 3"), (7, "x@y.zz" * 300), (8, "a@b.c+x@y.z.a@@b.c a@b.c..x@y 1.2.3.4.5.6.7.8 1..2.3.4.5"),
    (9, "7" * 6_000 + " @ " + "w" * 6_000 + "@ 1.1.1.1"),
]


def plain_spans(text):
    text, out = text or "", []
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    for kind, pattern in pii.BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2])))


def check_pii(rows, source):
    assert len(rows) == len(source)
    for r in rows:
        base = plain_spans(source[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS], r
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        every = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        added = [(k, int(s), int(e)) for k, s, e in every if (k, int(s), int(e)) not in base]
        assert {(k, int(s), int(e)) for k, s, e in every} >= set(base)
        assert not any(s < e2 and s2 < e for _, s, e in added for _, s2, e2 in base)
        assert listed([(k, int(s), int(e)) for k, s, e in every]) == r["spans"]


def test_pii_spans(spark, texts, none):
    docs_ = frame(spark, [(d, t, "en", "a") for d, t in PII])
    check_pii(pii.digest(pii.find(docs_)).collect(), dict(PII))
    check_pii(queries.op6_pii(spark, SF).collect(), {d: r["text"] for d, r in texts.items()})
    assert pii.digest(pii.find(none)).count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs_, pii.find(docs_)).collect()}
    assert red[1] == "ip [ip] 999.1.1.1 [ip].5 [ip]" and red[4] is None and red[5] == ""


def test_pii_model_adds_what_looks_like_the_rest(spark):
    rng = np.random.default_rng(5)

    def card():
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(d + c for c in "0123456789" if plain_spans(d + c))

    rows = [(i, f"some text {card()} and so on", "en", "a") for i in range(600)]
    rows += [(1000 + i, f"version {i}.2.{i} of {i * 7919 % 100000} pages", "en", "a") for i in range(300)]
    rows.append((5000, "some text 4111111111111112 and so on", "en", "a"))  # fails the checksum only
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(frame(spark, rows, clash=False))).collect()}
    assert found[5000] == "card:10:26"
    assert all(found[1000 + i] == listed(plain_spans(rows[600 + i][1])) for i in range(300))


def test_pii_thresholds_come_from_all_proposals(spark):
    rows = [(i, f"write to user{i}@site{i % 7}.org now", "en", "a") for i in range(280)]
    rows += [(1000 + i, "numbers " + " ".join(str(10**6 + 7919 * (i * 40 + k)) for k in range(40)), "en", "a") for i in range(750)]
    rows.append((5000, "write to someone(at)site3.org now", "en", "a"))
    scanned = common.stored(pii.scan(frame(spark, rows, clash=False)), "test")
    model = pii.fit(scanned)  # an email is under 1% of the proposals, and there are few
    assert pii.KINDS.index("email") in model.thresholds
    scored = spark.createDataFrame([(0, float(i < 97), 1.0) for i in range(100)] + [(1, 1.0, 0.5)] * 200 + [(1, 0.0, 0.25)] * 9 + [(2, 1.0, 1.0)] * 20,
                                   "kind int, label double, score double")
    assert pii.calibrate(scored, 0.98, 0.9) == {1: 0.5}


# --- packing

def check_packing(rows, source, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    expect, total = [], 0
    for d, t in source:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            expect.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(expect, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing(spark, texts, odd, none):
    used, bound = check_packing(queries.op7_best_fit_packing(spark, SF).collect(), [(d, r["text"]) for d, r in texts.items()])
    assert used <= bound * 1.03 + 1
    check_packing(packing.pack_documents(odd, queries.tokenizer_path()).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0
    packed = packing.pack_documents(odd, queries.tokenizer_path(), 512, with_ids=True)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert rows[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_word_tokenizer_equals_the_whole_one():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    own = packing.WordTokenizer(queries.tokenizer_path(), max_words=5)
    for text in ["Don't  it's 's I'LL", "<|endoftext|> x<|endoftext|>y <|start", "é ́x ‍ a\x1cb", "\x85 q\xa0r", "ǅ İ ς Σ ΑΣ",
                 "12 3.4a5", "ﬁ \r\n\x0b\x0c z", "日本 語", "  lead ", "ÀÉ­ª ½ ŉ ſ ß ẞ", "", "\x00\x01 a", "x" * 3000]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    counts[rng.integers(1, 257, 60)] = rng.integers(1, 400, 60)
    places, n = packing.plan(counts, 256, bins=32)
    used, have = Counter(), Counter()
    for row, follow in zip(places.tolist(), [*places.tolist()[1:], None]):
        length, first, copies, sequence, offset = row
        last = follow[1] if follow and follow[0] == length else int(counts[length])
        for k in range(last - first):
            used[sequence + k // copies] += length
        have[length] += last - first
    assert all(have[x] == counts[x] for x in range(1, 257)) and max(used.values()) <= 256
    assert set(used) == set(range(n)) and n <= 1.1 * (counts * np.arange(257)).sum() / 256 + 1


def test_non_negative_least_squares():
    rng = np.random.default_rng(2)
    a = rng.random((12, 30))
    b = a @ np.maximum(0, rng.normal(size=30))
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.allclose(a @ x, b, atol=1e-6)
    x = packing.nnls(a, -b)
    assert (x == 0).all()


# --- quality

def plain_counts(text):
    w, seen, dup = words(text), set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(runs)
    covered = {i + k for i, x in enumerate(runs) if n[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def check_quality(rows, source):
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows), key=str) == sorted(
        ((d, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for d, t in source for c in [plain_counts(t)]), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_counts(spark, texts, odd, none):
    check_quality(queries.op8_quality_rules(spark, SF).collect(), [(d, r["text"]) for d, r in texts.items()])
    check_quality(quality.judge(odd).collect(), [(r[0], r[1]) for r in ROWS])
    assert quality.judge(none).count() == 0
    for text in ["a b c d e f g h " * 2, "a " * 9, "a " * 8, "é# x\n\n# x\n# x  ", "a b c d e f g h i a b c d e f g h"]:
        assert quality.counts(text)[:5] == plain_counts(text)


def test_sketches_merge_and_keep_their_accuracy(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(0, 1, 400), np.zeros(50)])
    rows = spark.createDataFrame([("en", "a" if i % 3 else None, int(1e6), int(v * 1e6), 0, 0, 0, 1) for i, v in enumerate(values)],
                                 "lang string, source string, n_words long, n_symbols long, word_chars long, n_dup_lines long, n_repeat_words long, n_lines long")
    own = quality.sketch(rows, ["lang", "source"])
    merged = quality.merge(own, ["lang"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, quality.sketch(rows, ["lang"]).select(merged.columns).collect()))
    r = quality.quartiles(merged, ["lang"]).filter("rule = 'symbols'").first()
    s = np.sort(np.floor(values * 1e6) / 1e6)
    for q, got in ((0.25, r["q1"]), (0.75, r["q3"])):
        exact = s[int(np.ceil(q * len(s))) - 1]
        assert abs(got - exact) <= 0.0101 * exact


def test_thresholds_follow_the_group(spark):
    clean = "plain words of some length stand here without any marks at all and go on for a while longer than twenty words in every single document of this group "
    marked = " ".join(w + "|" for w in clean.split())
    rows = [(i, clean + str(i), "en", "prose") for i in range(150)] + [(1000 + i, marked + str(i), "en", "tables") for i in range(150)]
    rows += [(5000, " ".join(w + "|" for w in clean.split()), "en", "prose"), (6000, clean, "en", "tables")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, rows, clash=False)).collect()}
    assert not got.pop(5000) and all(got.values())


def test_thresholds_come_from_the_spread(spark):
    def text(i, marks, size):  # words of 4 + size letters on average
        w = [chr(97 + (i * 7 + k) % 26) * (4 + (k % 10 < size * 10)) + chr(97 + k % 26) for k in range(100)]
        return " ".join(x + "#" * (k < marks) for k, x in enumerate(w))

    # three of a hundred symbols a word in a tenth of one group, forty in a tenth of another
    rows = [(1000 * g + i, text(i, marks * (i % 10 == 0), (1 + i % 5) / 10), f"l{g}", "a") for g, marks in enumerate((3, 40)) for i in range(400)]
    rows += [(9000, text(1, 50, 0.2), "l0", "a"), (9001, text(1, 50, 0.2), "l1", "a")]
    # word lengths in a narrow band: 2.5 letters more are far out of it
    rows += [(9002, " ".join(x + "zz" + "z" * (k % 2) for k, x in enumerate(text(1, 0, 0.2).split())), "l0", "a")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, rows, clash=False)).collect()}
    assert not got.pop(9000) and not got.pop(9002) and all(got.values())


# --- nearest neighbours

def test_nearest_neighbours(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in common.table(spark, SF, "embeddings").collect()}
    ids, v = np.array(list(rows)), np.array(list(rows.values()))
    got = queries.op9_nearest_neighbours(spark, SF).collect()
    recall = check_near(got, ids, v, [i for i in rows if i % 50 == 0])
    assert recall >= 0.9
    # a small share of the cells
    few = ann.search(common.table(spark, SF, "embeddings"), F.col("vec_id") % 50 == 0, 5, share=0.1, centroids=6).collect()
    assert 0.3 < check_near(few, ids, v, [i for i in rows if i % 50 == 0]) < 1


def check_near(got, ids, v, asked):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = total = 0
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        score = u @ u[at]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and q not in [m[1] for m in mine]
        assert all(abs(s - score[ids == e][0]) < 1e-12 for _, e, s in mine)
        assert [(-s, e) for _, e, s in mine] == sorted((-s, e) for _, e, s in mine)
        score[at] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        hits += len({m[1] for m in mine} & set(best.tolist()))
        total += len(best)
    return hits / total


def test_vectors_that_take_no_part_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]),
            (7, [float("nan"), 1.0]), (8, [1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (10, [1e300, 1e-300])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") == 0, 5, block_rows=2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 10, 1.0), (0, 4, 3, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).collect() == []
    same = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.search(same, F.col("vec_id") % 50 == 0, 5, block_rows=32).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 3, 4, 5] and [r["vec_id"] for r in got if r["query_id"] == 250] == [0, 1, 2, 3, 4]


def test_cells_are_visited_by_distance():
    rng = np.random.default_rng(6)
    a, b, held = rng.random(7), rng.random(5), rng.integers(0, 9, 35)
    order = ann.visit(a, b, held, 10**9)
    expect = sorted((c for c in range(35) if held[c]), key=lambda c: a[c // 5] + b[c % 5])
    assert order == expect and ann.visit(a, b, held, 20) == expect[:len(ann.visit(a, b, held, 20))]


# --- mixing

def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {**target, **{s: level * weight[s] for s in free}}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def check_mix(rows, source, near):
    sizes, taken = Counter(), Counter()
    for d, t, s in source:
        sizes[s] += len(words(t))
    target = plain_targets(sizes)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=str) == sorted(((d, len(words(t))) for d, t, _ in source), key=str)
    home = {(d, len(words(t))): s for d, t, s in source}
    for r in rows:
        s = home[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) <= 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
        taken[s] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= near(s, t), (s, taken[s], t)


def test_mixing(spark, texts, odd, none):
    source = [(d, r["text"], r["source"]) for d, r in texts.items()]
    first = queries.op10_mixing(spark, SF).collect()
    check_mix(first, source, lambda s, t: 0.05 * t + 40)
    assert sorted(map(str, first)) == sorted(map(str, queries.op10_mixing(spark, SF).collect()))
    check_mix(mixing.mix_words(odd).collect(), [(r[0], r[1], r[3]) for r in ROWS], lambda s, t: 30_000)
    assert mixing.mix_words(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns


def test_mix_takes_its_copies(spark, docs):
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    assert got == +want


def test_dual_solution_tilts_by_size(spark):
    sizes = [(i, "word " * (1 + i % 50), "en", "abc"[i % 3]) for i in range(3000)]
    df = frame(spark, sizes, clash=False)
    base = spark.createDataFrame([(r[0], r[3], len(r[1].split())) for r in sizes], "doc_id long, source string, size long")
    targets = mixing.source_targets(base).cache()
    classes = base.join(targets.select("source", "sid"), "source").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n"))
    for r in classes.join(mixing.solve(classes, targets), "sid").join(targets, "sid").withColumn(
            "rate", F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(2.0))).groupBy("sid", "target").agg(
            F.sum(classes["n"] * F.col("rate") * F.col("size")).alias("words")).collect():
        assert abs(r["words"] - r["target"]) <= 1e-5 * r["target"]
    check_mix(mixing.mix_words(df).collect(), [(r[0], r[1], r[3]) for r in sizes], lambda s, t: 60)


# --- helpers and the pipeline

def test_gapless_index_and_ordered_index(spark):
    df = spark.createDataFrame([("k" if i % 3 else None, i, i // 2) for i in range(500)], "k string, i long, o long")
    got = common.gapless_index(df, ["k"], ["i"], ["o", "i"], "at", 8).collect()
    for k in ("k", None):
        assert sorted(r["at"] for r in got if r["k"] == k) == list(range(sum(r["k"] == k for r in got)))
    placed = common.ordered_index(df, [F.col("k").asc_nulls_last(), F.col("i").desc()], "at", "t").orderBy("at").collect()
    assert [r["at"] for r in placed] == list(range(500))
    assert [(r["k"] is None, -r["i"]) for r in placed] == sorted((r["k"] is None, -r["i"]) for r in placed)


def test_pipeline_stages(spark, odd, none, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    for start in (odd, none):
        docs_ = start
        for name, stage in corpus_pipeline.STAGES:
            out = common.stored(stage(spark, docs_, SF), "test")
            if name != "best_fit_packing":
                assert out.columns == odd.columns, name
                docs_ = out
        assert (out.count() == 0) == (start is none)
    rows = corpus_pipeline.run(spark, SF).collect()
    check = Counter()
    for r in rows:
        check[r["sequence_id"]] += r["length"]
    assert max(check.values()) <= 2048 and {r["doc_id"] for r in rows} <= set(texts)
