"""Evaluation texts leaking into a corpus: CGK embedding and bit-sampling LSH over windows sized by the item.

The CGK random walk reads a sequence of words with a pointer that, after each output, moves on or
stays by a random bit of the word read and the step. Two windows within a small edit distance fall
back into step, so edit distance becomes Hamming distance of the outputs. A hash of a few sampled
output positions then agrees with high probability; several samples over a few independent walks
reach the recall wanted. The longer an item, the longer its walks (``SCALES``); a short walk is the
beginning of a long one, so a text is walked once for all of them. Windows of an item end where the
item does, so each of them can be met.

Items too short for a walk are found by a run of half of their words, hashed exactly.

Windows start at every word of the corpus and of every item; the walks of a whole slice advance
together, one array operation per step. An item is a candidate in a document where enough of its
windows are met close to one diagonal. The verdict is the exact alignment of item and place: the
most words that can be matched in order, where a match counts if it stands in a run of three.

The corpus is read, split and walked once, whatever the number of items, and never shuffled. Their
index is laid out in flat files of bounded size, which Spark serves to its executors once and all
Python workers of a machine map into memory together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small_slices, split_words, word_hashes

#: (least words of an item, outputs of its walks, output positions in a hash, least number and least share of its window starts to be met)
SCALES = ((8, 8, 4, 1, 0.1), (24, 16, 7, 2, 0.1), (64, 32, 12, 4, 0.08))
#: hashes per walk, walks
SAMPLES, WALKS = 4, 2
#: diagonals are counted in strips of this many words; two neighbouring strips count together
STRIP = 64
#: words that may lie between the parts of a passage
BETWEEN = 60
#: share of the item's words that must be found in order in one place
MIN_WORDS = 0.5
#: share of the words that must be found in the stretch of the item that is carried; the rest are its changed words
DENSE = 2 / 3
#: words of items in one file of the index
FILE_WORDS = 1_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def sampled_positions(scale: int) -> np.ndarray:
    """(walk, sample) -> the output positions in that hash; fixed by a seed."""
    _, steps, sampled, _, _ = SCALES[scale]
    rng = np.random.default_rng(20 + scale)
    return np.array([[np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)])


def steer(symbols: np.ndarray, walk: int) -> np.ndarray:
    """64 random bits per symbol and walk; none for the end."""
    x = symbols * np.uint64(2 * walk + 3) * _PRIME
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(symbols == 0, np.uint64(0), x ^ (x >> np.uint64(27)))


def cgk_hashes(symbols: np.ndarray, moves: np.ndarray, samples: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per entry of ``samples`` the hash of each start's outputs at those positions, and where the walk then stands.

    ``moves`` steer the walk. The symbol 0 ends a text: its bits are 0, so a walk never passes it.
    """
    at = np.arange(symbols.size, dtype=np.int32)
    out = [np.zeros(symbols.size, np.uint64) for _ in samples]
    ends = [at] * len(samples)
    steps = max((int(s[-1]) for s in samples), default=-1) + 1
    for step in range(steps):
        here = [k for k, s in enumerate(samples) if step in s]
        if here:
            read = symbols[at]
            for k in here:
                out[k] *= _PRIME
                out[k] += read
                if step == samples[k][-1]:
                    ends[k] = at
        if step + 1 < steps:
            at = at + ((moves[at] >> np.uint64(step)) & _ONE).astype(np.int32)
    for h in out:
        h ^= h >> np.uint64(29)
    return list(zip(out, ends, strict=True))


def runs_of(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words, one per start that has one."""
    n = max(symbols.size - length + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _PRIME + symbols[k : k + n]
    return out


def _hashes(symbols: np.ndarray, functions: list[tuple]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(function, hash of every start, last word it reads). Functions are ('walk', scale, walk, sample) or ('run', length)."""
    positions = {s: sampled_positions(s) for s in range(len(SCALES))}
    for walk in range(WALKS):
        own = [f for f in functions if f[0] == "walk" and f[2] == walk]
        if own:
            hashed = cgk_hashes(symbols, steer(symbols, walk), [positions[f[1]][walk][f[3]] for f in own])
            yield from ((f, h, z) for f, (h, z) in zip(own, hashed, strict=True))
    for f in functions:
        if f[0] == "run":
            h = np.zeros(symbols.size, np.uint64)
            h[: max(symbols.size - f[1] + 1, 0)] = runs_of(symbols, f[1])
            yield f, h, np.arange(symbols.size) + f[1] - 1


def run_length(words: int) -> int:
    """Words that must stand together for an item of so many words to be a candidate, if it is too short for a walk."""
    return min(words, max(2, words // 2))


def supporting_run(words: int) -> int:
    """Length of the common run in which a matched word must stand to count: three, but in short items two."""
    return min(words, 3 if words >= 12 else 2)


class Items:
    """The windows of some items, ready for lookup; all of it flat arrays, so that a file can hold it."""

    def __init__(self, flat: np.ndarray, layout: dict):
        self.flat, self.layout = flat, layout
        self.ids, self.first, self.symbols = self._part("ids").view(np.int64), self._part("first").view(np.int64), self._part("symbols")
        self.size = np.diff(self.first) - 1  # every item has an end mark
        self.deep = int(self.size.max(initial=0)) + 1
        self.need = self._part("need").view(np.int64)
        self._grams: dict[int, tuple[np.ndarray, dict[int, int]]] = {}

    def _part(self, name) -> np.ndarray:
        a, z = self.layout[name]
        return self.flat[a:z]

    @property
    def functions(self) -> list[tuple]:
        return [k for k in self.layout if isinstance(k, tuple)]

    @classmethod
    def build(cls, ids: list[int], texts: list[str]) -> Items:
        words, starts = split_words(pa.array(texts, pa.string()))
        table = word_hashes(words.dictionary, 1)
        flat = table[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        owned = [(i, w) for i, a, z in zip(ids, starts[:-1], starts[1:], strict=True) if (w := flat[a:z][flat[a:z] != 0]).size]
        size = np.array([w.size for _, w in owned], np.int64)
        symbols = np.concatenate([np.append(w, np.uint64(0)) for _, w in owned]) if owned else np.zeros(0, np.uint64)
        first = np.concatenate(([0], np.cumsum(size + 1))).astype(np.int64)
        owner = np.repeat(np.arange(size.size), size + 1)
        scale_of = np.searchsorted([s[0] for s in SCALES], size, "right") - 1
        need = np.array([max(SCALES[s][3], np.ceil(SCALES[s][4] * n)) if s >= 0 else 1 for s, n in zip(scale_of, size, strict=True)], np.int64)
        functions: list[tuple] = [("walk", s, w, k) for s in range(len(SCALES)) if (scale_of == s).any() for w in range(WALKS) for k in range(SAMPLES)]
        functions += [("run", n) for n in sorted({run_length(int(n)) for n in size[scale_of < 0]})]
        lengths = np.array([run_length(int(n)) for n in size], np.int64)
        sizes: dict[tuple, int] = {}
        parts = {"ids": np.array([i for i, _ in owned], np.int64), "first": first, "symbols": symbols, "need": need}
        for f, h, z in _hashes(symbols, functions):
            mine = scale_of[owner] == f[1] if f[0] == "walk" else (scale_of[owner] < 0) & (lengths[owner] == f[1])
            use = np.flatnonzero(mine & (symbols != 0) & (z < first[owner + 1] - 1))
            order = use[np.argsort(h[use], kind="stable")]
            bits = 1 << max(int(32 * order.size - 1).bit_length(), 12)
            filled = np.zeros(bits, bool)
            filled[(h[order] & np.uint64(bits - 1)).astype(np.int64)] = True
            place = (order - first[owner[order]]).astype(np.uint64)
            parts[f] = np.concatenate((np.packbits(filled, bitorder="little").view(np.uint64), h[order], (owner[order].astype(np.uint64) << np.uint64(32)) | place))
            sizes[f] = bits
        layout, at = {}, 0
        for k, p in parts.items():
            layout[k] = (at, at + p.size, sizes[k]) if k in sizes else (at, at + p.size)
            at += p.size
        return cls(np.concatenate([p.view(np.uint64) for p in parts.values()]), layout)

    def lookup(self, function: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, place in the item) of every start whose hash some item's window has."""
        a, z, bits = self.layout[function]
        part = self.flat[a:z]
        words = bits // 64
        n = (part.size - words) // 2
        low = h & np.uint64(bits - 1)
        at = np.flatnonzero((part[:words][(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & _ONE)
        table, where = part[words : words + n], part[words + n :]
        begin = np.searchsorted(table, h[at], "left")
        count = np.searchsorted(table, h[at], "right") - begin
        at, begin, count = at[count > 0], begin[count > 0], count[count > 0]
        pick = where[np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64), count) + np.arange(count.sum())] if at.size else np.zeros(0, np.uint64)
        return np.repeat(at, count), (pick >> np.uint64(32)).astype(np.int64), (pick & np.uint64(2**32 - 1)).astype(np.int64)

    def grams(self, item: int) -> tuple[np.ndarray, dict[int, int]]:
        """An item's runs of the supporting length, and each one's places as bits."""
        if item not in self._grams:
            if len(self._grams) > 2000:
                self._grams.clear()
            runs = runs_of(self.symbols[self.first[item] : self.first[item + 1] - 1], supporting_run(int(self.size[item])))
            places: dict[int, int] = {}
            for k, x in enumerate(runs.tolist()):
                places[x] = places.get(x, 0) | (1 << k)
            self._grams[item] = runs, places
        return self._grams[item]


def words_in_order(places: dict[int, int], n: int, runs: list[int], length: int) -> np.ndarray:
    """Words of an item of n words that the best alignment with a text matches in order, each in a common run of ``length``.

    ``runs`` are the text's runs, one per start; ``places`` the bits of the item's. The longest common
    subsequence (the complement of the edit distance by insertions and deletions) over these matches, bit-parallel.
    """
    full = (1 << n) - 1
    v = full
    last = [0] * length  # matches that began 0, 1, ... words before
    for x in [*runs, *[0] * (length - 1)]:
        last = [places.get(x, 0) if x else 0, *last[:-1]]
        m = 0
        for back, bits in enumerate(last):
            m |= bits << back
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return np.flatnonzero(np.frombuffer(f"{v:0{n}b}".encode(), np.uint8)[::-1] == ord("0"))


def is_carried(matched: np.ndarray, n: int) -> bool:
    """Whether half of an item's words are matched within a stretch of it in which few are changed."""
    half = int(np.ceil(MIN_WORDS * n))
    return matched.size >= half and half >= DENSE * int((matched[half - 1 :] - matched[: matched.size - half + 1]).min() + 1)


class _Texts:
    """A slice of the corpus as symbols, an end after every text."""

    def __init__(self, texts: pa.Array):
        words, starts = split_words(texts)
        table = word_hashes(words.dictionary, 1)
        flat = table[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        self.size = np.diff(starts)
        self.symbols = np.zeros(flat.size + self.size.size, np.uint64)
        self.symbols[np.arange(flat.size) + np.repeat(np.arange(self.size.size), self.size)] = flat
        self.begin = starts[:-1] + np.arange(self.size.size)
        self.text_of = np.repeat(np.arange(self.size.size), self.size + 1)


def _candidates(items: Items, texts: _Texts, hashed: list[tuple[tuple, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(text, item, first diagonal of a strip) wherever enough windows of an item are met in that strip and the next."""
    # strips are numbered through the slice, with room before every text for an item that begins earlier
    before = -(-items.deep // STRIP) + 1
    strips = np.concatenate(([0], np.cumsum(texts.size // STRIP + before + 2)))
    total, found = int(strips[-1]), []
    for f, h in hashed:
        if f not in items.layout:
            continue
        at, item, place = items.lookup(f, h)
        text = texts.text_of[at]
        strip = strips[text] + before + (at - texts.begin[text] - place) // STRIP
        found.append(np.unique((item * total + strip) * items.deep + place))
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not code.size:
        return
    key = code // items.deep
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, number = key[cut], np.diff(np.append(cut, code.size))
    following = np.zeros(key.size, np.int64)
    following[:-1] = np.where(key[1:] == key[:-1] + 1, number[1:], 0)
    for k in np.flatnonzero(number + following >= items.need[key // total]):
        item, strip = divmod(int(key[k]), total)
        text = int(np.searchsorted(strips, strip, "right")) - 1
        yield text, item, (strip - int(strips[text]) - before) * STRIP


class _Runs:
    """The runs of one length in a slice, as numbers into their sorted vocabulary."""

    def __init__(self, symbols: np.ndarray, length: int):
        self.vocabulary, self.number = np.unique(runs_of(symbols, length), return_inverse=True)
        self.flag = np.zeros(self.vocabulary.size, bool)

    def known(self, runs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, runs)
        at = at[at < self.vocabulary.size]
        return at[np.isin(self.vocabulary[at], runs)]


def _places(hits: np.ndarray, n: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of n + BETWEEN words that hold enough words in common runs; ``hits`` are the runs' starts."""
    covered = np.unique(hits[:, None] + np.arange(length))
    heads = hits[np.concatenate(([True], np.diff(hits) > 1))]
    inside = np.searchsorted(covered, heads + n + BETWEEN) - np.searchsorted(covered, heads)
    for h in heads[inside >= MIN_WORDS * n].tolist():
        yield h, h + n + BETWEEN


def _verdicts(items: Items, texts: _Texts, hashed: list[tuple[tuple, np.ndarray]]) -> dict[tuple[int, int], float]:
    best: dict[tuple[int, int], float] = {}
    runs: dict[int, _Runs] = {}
    open_item = -1
    for text, item, diagonal in _candidates(items, texts, hashed):
        n = int(items.size[item])
        length = supporting_run(n)
        if length not in runs:
            runs[length] = _Runs(texts.symbols, length)
        there = runs[length]
        if item != open_item:  # candidates come item by item
            there.flag[:] = False
            there.flag[there.known(items.grams(item)[0])] = True
            open_item = item
        begin, end = int(texts.begin[text]), int(texts.begin[text] + texts.size[text])
        a, z = max(begin + diagonal - 8, begin), min(begin + diagonal + 2 * STRIP + n + BETWEEN, end)
        hits = a + np.flatnonzero(there.flag[there.number[a : max(z - length + 1, a)]])
        if hits.size * length < MIN_WORDS * n:
            continue
        for a, z in _places(hits, n, length):
            stretch = there.vocabulary[there.number[a : max(min(z, end) - length + 1, a)]]
            matched = words_in_order(items.grams(item)[1], n, stretch.tolist(), length)
            if is_carried(matched, n):
                best[text, item] = max(matched.size / n, best.get((text, item), 0))
    return best


def find_in_batch(shards: list[Items], texts: pa.Array) -> tuple[list[int], list[int], list[float]]:
    """(row, item id, share of the item's words) of the texts that carry an item."""
    slice_ = _Texts(texts)
    functions = list(dict.fromkeys(f for s in shards for f in s.functions))
    hashed = [(f, h) for f, h, _ in _hashes(slice_.symbols, functions)]
    rows: list[tuple[int, int, float]] = []
    for s in shards:
        rows += [(text, int(s.ids[item]), share) for (text, item), share in sorted(_verdicts(s, slice_, hashed).items())]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def _search(files: list[tuple[str, dict]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Items(np.load(SparkFiles.get(name), mmap_mode="r"), layout) for name, layout in files]
        for batch in (part for whole in batches for part in small_slices(whole, "text")):
            rows, found, share = find_in_batch(shards, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(found, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "share"])

    return run


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, file_words: int = FILE_WORDS) -> DataFrame:
    """(doc_id, item_id, share): documents that carry at least half of an item's words in order and in one place.

    Letter case, punctuation, line breaks and words divided at line ends don't matter; changed words or text put
    in between are tolerated. A word counts if it stands in a run of three words that item and document share (of
    two if the item has under twelve words), and of the stretch of the item that is carried at most one word in
    three may be changed; ``share`` is the share of the item's words that count.
    An item of under eight words is found where a run of half of its words, two at least, stands unchanged;
    a single word wherever it occurs. Longer ones are found by windows, with the recall that the tests measure.
    Each document counts on its own, copies included; a document row that comes again is reported again, and so is
    an item row. Null or empty texts and null ids carry nothing and are in nothing. Only the named columns
    are read; empty tables give no rows.

    The corpus is read once. Items are a query set: they come to the driver in parts of about ``file_words``
    words at most (one longer item is a part of its own), one after another, and leave it as files of the index.
    """
    spark = items.sparkSession
    queries = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    # a word has two characters with its space at least, mostly more than five
    parts = -(-int(queries.agg(F.sum(F.length("text"))).first()[0] or 0) // (5 * file_words))
    files = []
    for p in range(parts):
        part = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        index = Items.build([r["item_id"] for r in part], [r["text"] for r in part])
        if index.ids.size:
            path = Path(SparkFiles.getRootDirectory()) / f"leak-items-{uuid.uuid4().hex}.npy"
            np.save(path, index.flat)
            spark.sparkContext.addFile(str(path))
            files.append((path.name, index.layout))
    if not files:
        return spark.createDataFrame([], "doc_id long, item_id long, share double")
    return corpus.mapInArrow(_search(files), "doc_id long, item_id long, share double")
