"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Only the histogram of piece lengths is planned, on the driver (at most ``capacity``
counts): few-document patterns of binned lengths that fill a sequence are fitted to the
histogram by non-negative least squares, the repeat counts rounded and their sequences filled, and
what remains is packed best-fit, longest first, into the room that patterns leave and into
new sequences.  Every piece then finds its place from its length and its number among the
pieces of that length.

Defined cases: a NULL text is an empty one: one piece that holds only the end id; longer
documents than the capacity are cut into full pieces, the last may be shorter; repeated
rows are packed each; NULL ids stay; an empty table gives no sequences; further columns are
ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.llm.common import TEXT_ROWS, gapless_index, release_memory, ship, stored

#: white space besides the blank at which texts are split into words
_SPACES = "\t\n\x0b\x0c\r"
#: words and parts that a worker keeps: some 75 MB of it
MAX_WORDS = 300_000
#: longer words (in characters) are rarely met again
LONG_WORD = 64
#: bytes of the texts that are cut into parts at once (a longer text alone)
TEXT_BYTES = 1 << 20

#: the pattern that ``part_bounds`` follows
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: texts that hold other than white space, printable Latin letters (not U+0130, whose small letter is two characters,
#: nor those from U+023A on, some of which have three bytes), common punctuation,
#: or that may hold a special token
_ODD = "[^\t-\r -~\xa1-\xac\xae-\u012f\u0131-\u0239\u2010-\u2027]|<\\|"
_SPACE, _LETTER, _NUMBER, _SYMBOL = range(4)
#: kind of every character of one or two UTF-8 bytes
_KINDS = np.array([_SPACE if chr(c) in " " + _SPACES else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SYMBOL)
                   for c in range(0x800)], np.uint8)


def _words(text: str) -> list[str]:
    for c in _SPACES:
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def _byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if it is printable
    Latin-1, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _offsets(found: pa.LargeStringArray | pa.LargeBinaryArray) -> np.ndarray:
    """Where each of ``found`` begins in its bytes, and the end of the last."""
    if not len(found):
        return np.zeros(1, np.int64)
    return np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1]


def part_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts by ``_PATTERN`` and runs of white space begin in the UTF-8 bytes ``data`` of lower-case texts that are not
    odd (``starts``: their first bytes), with the end of ``data``; and whether each is a part."""
    kind = _KINDS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    kind[lead] = kind[lead + 1] = _KINDS[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    lead = np.flatnonzero(data >= 0xE0)  # punctuation
    kind[lead] = kind[lead + 1] = kind[lead + 2] = _SYMBOL
    new = np.ones(len(data) + 3, bool)  # and two beyond the end
    np.not_equal(kind[1:], kind[:-1], out=new[1:len(data)])
    new[:len(data)] |= (kind == _NUMBER) & (data & 0xC0 != 0x80)
    new[starts] = True
    after = np.append(data, [0, 0])
    short = np.flatnonzero((data == ord("'")) & new[:len(data)] & new[1:len(data) + 1])
    for suffix in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        # the suffix is of the same text, and its bytes of one run
        at = short[(after[short + 1] == suffix[0]) & ~np.isin(short + 1, starts)]
        if len(suffix) == 2:
            at = at[(after[at + 2] == suffix[1]) & ~new[at + 2]]
        new[at + 1] = False
        new[at + 1 + len(suffix)] = True
    bounds = np.flatnonzero(new[:len(data) + 1])
    return bounds, kind[bounds[:-1]] != _SPACE


class WordTokenizer(dict):
    """Ids (little-endian unsigned 32-bit) of words, for tokenizers that drop white space, never
    join across it, and lower-case.

    Words and their parts are kept, at most ``max_words`` and those of one text (or of the texts cut at once): half of them are the
    ones met lately, and when these are as many, the older half is forgotten.  Words of over
    ``LONG_WORD`` characters are not kept.  Printable words of Latin letters are cut into parts by the
    tokenizer's own pattern and given to its model directly; any other goes through the whole tokenizer.  Many texts are
    cut into parts together, but for odd ones (other scripts, control characters), which go word by word."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        steps = json.loads(self.tokenizer.pre_tokenizer.__getstate__())["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"]
        self.parts, self.by_bounds = regex.compile(pattern).findall, pattern == _PATTERN
        self.letters = _byte_letters()
        self.model = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}
        self[""] = b""

    def cut(self, text: str) -> bytes:
        found = self.model(text)
        return found[0].id.to_bytes(4, "little") if len(found) == 1 else array("I", [t.id for t in found]).tobytes()

    def part(self, p: str) -> bytes:
        found = self.get(p) or self.older.get(p)
        if found is None:
            found = self.cut(p if p.isascii() else "".join([self.letters[b] for b in p.encode()]))
        if len(p) <= LONG_WORD:
            self[p] = found
        return found

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            small = word.lower()
            if small.isascii() and small.isalpha():  # one part
                ids = self.cut(word) if small == word else self.part(small)
            elif word.isprintable() and max(word) < "\u0250" and "<|" not in word:
                ids = b"".join([self.get(p) or self.part(p) for p in self.parts(small)])
            else:
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def forget(self) -> None:
        if 2 * len(self) > self.max_words:
            self.older = dict(self)
            self.clear()
            self[""] = b""

    def ids(self, text: str) -> bytes:
        self.forget()
        return b"".join(map(self.__getitem__, _words(text)))

    def plain_ids(self, texts: pa.LargeStringArray) -> list[bytes]:
        """Ids of texts that are not odd: all are cut into parts together and each different part is looked up once."""
        self.forget()
        small = pc.utf8_lower(texts)
        starts = _offsets(small)
        buffer = pa.py_buffer(small.buffers()[2] or b"")
        bounds, is_part = part_bounds(np.frombuffer(buffer, np.uint8)[:starts[-1]], starts)
        runs = pa.Array.from_buffers(pa.large_string(), len(is_part), [None, pa.py_buffer(bounds), buffer])
        found = runs.filter(pa.array(is_part)).dictionary_encode()
        different = pa.array([self.get(p) or self.part(p) for p in found.dictionary.to_pylist()], pa.large_binary())
        ids = different.take(found.indices)
        parts_before = np.append(0, np.cumsum(is_part))[np.searchsorted(bounds, starts)]
        ends = _offsets(ids)[parts_before].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[lo:hi]) for lo, hi in zip(ends, ends[1:])]

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of every text (NULL: none), in order, some ``TEXT_BYTES`` of them at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        before = np.cumsum(pc.binary_length(texts).to_numpy()) // TEXT_BYTES
        firsts = np.flatnonzero(np.diff(before, prepend=-1)).tolist()
        for lo, hi in zip(firsts, [*firsts[1:], len(texts)]):
            some = texts.slice(lo, hi - lo)
            odd = pc.match_substring_regex(some, _ODD) if self.by_bounds else pa.array([True] * len(some))
            plain = iter(self.plain_ids(some.filter(pc.invert(odd))))
            for i, is_odd in enumerate(odd.to_pylist()):
                yield self.ids(some[i].as_py()) if is_odd else next(plain)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
           max_words: int = MAX_WORDS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked, ``ids``: every document's
    ids and the end id, cut at ``capacity``.  A worker keeps the tokenizer and up to ``max_words`` words that it
    has met, also for its next partition: 300,000 take some 75 MB of it for good."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        _TOKENIZERS[tokenizer].max_words = max_words
        for b in batches:
            found = _TOKENIZERS[tokenizer].all_ids(b.column(1))
            for lo in range(0, b.num_rows, 256):
                rows, out = [], []
                for n, raw in enumerate(islice(found, 256)):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        rows.append(lo + n)
                        out.append((k, at // 4, len(part) // 4, zlib.crc32(part), part))
                piece, start, length, crc, raw_ids = zip(*out)
                columns = [b.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in raw_ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        release_memory()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(each, schema)


def patterns(lengths: list[int], capacity: int, slack: int) -> list[tuple[int, ...]]:
    """All one to three of ``lengths`` (rising), falling, whose sum is at most ``capacity`` and less
    than ``slack`` below it."""
    out = [(x,) for x in lengths if capacity - slack < x <= capacity]
    for i, x in enumerate(lengths):
        for j in range(i + 1):
            y = lengths[j]
            if x + y > capacity:
                break
            if x + y > capacity - slack:
                out.append((x, y))
            for k in range(bisect_right(lengths, capacity - slack - x - y, 0, j + 1), j + 1):
                if x + y + lengths[k] > capacity:
                    break
                out.append((x, y, lengths[k]))
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    for _ in range(steps):
        slope = a.T @ (b - a[:, active] @ x[active])
        slope[active] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-9 * max(1.0, float(b.max(initial=0))):
            break
        active.append(k)
        while True:
            s = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (s > 1e-12).all():
                x[active] = s
                break
            now = x[active]
            low = s <= 1e-12
            step = np.min(now[low] / np.maximum(now[low] - s[low], 1e-300))
            now = now + step * (s - now)
            x[active] = now
            gone = {active[i] for i in np.flatnonzero(low) if now[i] <= 1e-9}
            if not gone:
                gone = {active[int(np.flatnonzero(low)[now[low].argmin()])]}
            for i in gone:
                x[i] = 0
            active = [i for i in active if i not in gone]
    return x


@dataclass
class Plan:
    """``rows`` (length, first, copies, sequence, offset) in order: the pieces numbered from ``first`` of a length go
    ``copies`` at a time, from ``offset`` on, to ``sequence`` and those after it.  ``by_patterns``: pieces that the fitted
    patterns place, of ``pieces`` in all."""

    rows: np.ndarray
    sequences: int
    by_patterns: int
    pieces: int


def plan(counts: np.ndarray, capacity: int, bins: int = 64) -> tuple[np.ndarray, int]:
    """Rows and number of sequences of ``planned``."""
    found = planned(counts, capacity, bins)
    return found.rows, found.sequences


def planned(counts: np.ndarray, capacity: int, bins: int = 64) -> Plan:
    """Places for ``counts[length]`` pieces.

    Lengths are binned, the longest that occurs stands for its bin, and the patterns are those of
    at most three bins that fill a sequence but for less than the width of a bin.  Missing a
    piece weighs as much as it is long.  The fitted repeat counts are rounded so that they keep their sum (the
    largest remainders go up), and their sequences filled with pieces of the bins that leave
    the least room."""
    width = -(-capacity // bins)
    there = np.flatnonzero(counts[:capacity + 1])
    there = there[there > 0]
    if not len(there):
        return Plan(np.empty((0, 5), np.int64), 0, 0, 0)
    starts = np.flatnonzero(np.diff((there - 1) // width, prepend=-1))
    longest = [int(x) for x in there[np.append(starts[1:], len(there)) - 1]]
    held = np.add.reduceat(counts[there], starts)
    members = {x: there[i:j][::-1].tolist() for x, i, j in zip(longest, starts, np.append(starts[1:], len(there)))}
    ways = patterns(longest, capacity, width)
    place = {x: i for i, x in enumerate(longest)}
    a = np.zeros((len(longest), len(ways)))
    for j, way in enumerate(ways):
        for x in way:
            a[place[x], j] += x / capacity
    repeats = nnls(a, held * np.array(longest) / capacity)
    return fill(counts, capacity, members, ways, whole_repeats(repeats))


def whole_repeats(repeats: np.ndarray) -> np.ndarray:
    """Whole numbers near ``repeats`` with (about) the same sum: rounded down, then the largest remainders up."""
    whole = np.floor(repeats + 1e-6).astype(np.int64)
    left = repeats - whole
    up = np.argsort(-left, kind="stable")[:max(0, int(round(float(left.sum()))))]
    whole[up[left[up] > 1e-6]] += 1
    return whole


class Filling:
    """Sequences under way, in groups of equal ones: ``groups[i]`` is (sequences, room, (length, copies) ...)."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = counts[:capacity + 1].astype(np.int64)
        self.left[0] = 0
        self.capacity = capacity
        self.groups: list[tuple[int, int, tuple[tuple[int, int], ...]]] = []
        self.rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)  # rooms that a group has

    def put(self, n: int, room: int, inside: tuple[tuple[int, int], ...]) -> None:
        if n:
            self.groups.append((n, room, inside))
            self.rooms[room].append(len(self.groups) - 1)
            self.some[room] = True

    def longest(self, most: int, taken: tuple[int, ...] = ()) -> int:
        """The longest piece left, of at most ``most``, when one of each of ``taken`` is gone; 0 if none."""
        for length in range(most, 0, -1):
            if self.left[length] > taken.count(length):
                return length
        return 0

    def repeat(self, way: tuple[int, ...], members: dict[int, list[int]], times: int) -> None:
        """Fill ``times`` sequences by a pattern of bins: the longest pieces of its first bins, and of the last
        two those whose sum leaves the least room (the last may be of a lower bin)."""
        while times > 0:
            first: tuple[int, ...] = ()
            for part in way[:-2]:
                pick = next((x for x in members[part] if self.left[x] > first.count(x)), 0)
                if not pick:
                    return
                first += (pick,)
            room = self.capacity - sum(first)
            options = [(x,) for x in members[way[-2]] if x <= room and self.left[x] > first.count(x)] if len(way) > 1 else [()]
            best = None
            for option in options:
                here = first + option
                last = self.longest(self.capacity - sum(here), here)
                waste = self.capacity - sum(here) - last
                if last and (best is None or waste < best[0]):
                    best = (waste, (*here, last))
                    if not waste:
                        break
            if best is None:
                return
            waste, lengths = best
            n = min(times, *(int(self.left[x]) // lengths.count(x) for x in set(lengths)))
            for x in lengths:
                self.left[x] -= n
            self.put(n, waste, tuple((x, 1) for x in lengths))
            times -= n

    def rest(self) -> None:
        """What is left, longest first, into the least room that takes it, or new sequences."""
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                room = length + int(self.some[length:].argmax())
                if not self.some[room]:
                    each = min(self.capacity // length, int(self.left[length]))
                    n = int(self.left[length]) // each
                    self.put(n, self.capacity - each * length, ((length, each),))
                    self.left[length] -= n * each
                    continue
                g = self.rooms[room].pop()
                self.some[room] = bool(self.rooms[room])
                n, _, inside = self.groups[g]
                each = min(room // length, int(self.left[length]))
                use = min(n, int(self.left[length]) // each)
                self.groups[g] = (0, 0, ())
                self.put(n - use, room, inside)
                self.put(use, room - each * length, (*inside, (length, each)))
                self.left[length] -= use * each


def fill(counts: np.ndarray, capacity: int, members: dict[int, list[int]], ways: list[tuple[int, ...]], repeats: np.ndarray) -> Plan:
    """The plan that repeats ``ways`` (of bins, with their ``members``) and packs the rest."""
    pieces = int(counts[1:capacity + 1].sum())
    under_way = Filling(counts, capacity)
    for j in np.argsort(-repeats, kind="stable"):
        under_way.repeat(ways[j], members, int(repeats[j]))
    by_patterns = pieces - int(under_way.left.sum())
    under_way.rest()
    taken = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for n, _, inside in under_way.groups:
        at = 0
        for length, each in inside if n else ():
            rows.append((length, int(taken[length]), each, sequence, at))
            taken[length] += n * each
            at += length * each
        sequence += n
    rows.sort()
    return Plan(np.array(rows, np.int64).reshape(-1, 5), sequence, by_patterns, pieces)


def pack(cut: DataFrame, capacity: int = 2048, bucket_rows: int = 500_000) -> DataFrame:
    """``cut`` (pieces, computed once) with ``sequence_id`` and ``offset``.  Pieces of one length are
    numbered in buckets of about ``bucket_rows`` at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    places, _ = plan(counts, capacity)
    buckets = max(64, -(-int(counts.max()) // bucket_rows))
    starts = (places[:, 0] << 40) + places[:, 1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            index = b.column(b.schema.get_field_index("_index")).to_numpy()
            at = np.searchsorted(starts, (length << 40) + index, side="right") - 1
            _, first, copies, sequence, offset = places[at].T
            columns = [c for c, name in zip(b.columns, b.schema.names) if name != "_index"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence + (index - first) // copies), pa.array(offset + (index - first) % copies * length)],
                schema.names)

    numbered = gapless_index(cut, ["length"], ["doc_id", "piece"], ["doc_id", "piece", "ids_crc32"], "_index", buckets)
    schema = T.StructType([*[f for f in numbered.schema.fields if f.name != "_index"],
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(each, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                   max_words: int = MAX_WORDS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``: the place of
    every piece of every document in sequences of at most ``capacity`` ids."""
    return pack(stored(pieces(docs, tokenizer, capacity, end_id, with_ids, max_words), "pieces", TEXT_ROWS), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of documents packed ``with_ids``: at most a capacity a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
