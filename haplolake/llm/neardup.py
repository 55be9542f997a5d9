"""Near-duplicate records: every pair of a block that may be near is found by a sieve, then verified exactly.

Each text is compared with all texts of its block of fitting length. A near pair has to share a
number of short grams; one bit for each gram a text has makes that a few words to intersect for a
pair, many pairs at once. The bound holds for any near pair, so nothing is lost, whatever the other
texts are. Blocks are cut into pieces by length,
and every two pieces whose lengths can meet are a task, which verifies what passes and sends only
links on. Work grows with the square of a block's texts.

Where that is too much, ``near_pairs`` takes ``large``: then only texts with a common signature are
compared, and recall is measured instead of exact. Work is less only if the texts of a block have no
stretch (primers and the like) in common.

PartEnum signatures over the feature sets of equal size bands: the features of a sequence are its
q-grams. Every size band divides the feature domain into parts
of less than one feature per sequence on average, and signs each of the first ``parts`` of them:
the signature of a part is a digest of all features a sequence has in it. Two sequences share a
signature wherever none of their differing features fell; the number of parts is chosen so that a
pair at the limit of the wanted similarity shares several. A signature that very many sequences
share (a hot bucket) is compared block by block over many tasks, so no bucket is cut and none sits
in one task; of these pairs only those go on that share as many short grams as near ones must. One that
is hot within a single batch already is spread before the shuffle. Whether two texts are compared
depends on these two texts only, never on how many others there are.

This is the enumeration with one differing part to a first-level partition allowed to be any: as many
edits as are permitted here touch more features than a set has, so subsets of two or more parts would
share less than single parts do. Recall is measured by the tests, not guaranteed.

Stretches that nearly all texts of a block share (primers and the like) put unrelated texts into
common buckets. They sign like any other, as a pair may have nothing else left in common: the hot
signatures of a good share of a block's texts are compared as one bucket, each pair once.

Candidates are verified exactly: edit distance by bit-parallel columns over many pairs at once,
and, if that is too large, edit distance after one contiguous stretch is put back in its place. The
stretch is guessed from common anchors; where that gives nothing, all places are searched by branch
and bound: moving one of its three joints by one base changes the distance by two at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: bases of a feature; random sequences of a few hundred bases share almost none of this length
Q = 14
#: below this length features are shorter: (least length of a band, bases of its features), so that permitted edits leave some whole
SHORT, SHORT_FEATURES = 64, ((32, 8), (16, 6), (8, 4))
#: tasks that the members of a signature are spread over if it is hot in one batch already
SALTS = 64
#: signed parts per sequence
PARTS = 72
#: average features per part in the middle of a size band
FEATURES_PER_PART = 0.72
#: members from which a signature's bucket counts as hot
LARGE = 200
#: members of a hot bucket in one block; each is sent once per block of its bucket
BLOCK = 2000
#: hot signatures of one in so many of a block's texts are compared together
WIDE = 3
#: lengths of the grams that near texts must share in some number, and bits that stand for them (one for each gram of A, C, G, T): a quick sieve, then a fine one
SHARED_GRAMS = ((5, 1024), (6, 4096))
#: the same for the comparison of whole blocks: (letters of the longer text up to which they serve, length of the grams); edits break all
#: longer ones of a brief text, and a long text has all shorter ones
GRAMS_BY_LENGTH = ((39, 4), (400, 5), (1500, 6), (5000, 7), (14_000, 8), (40_000, 9), (2**31, 10))
#: least and most letters in a piece of a block; between them a block has so many pieces
PIECE, PIECES = (1_000_000, 20_000_000), 16
#: texts that are sieved together, others that they meet at once, and pairs verified together
TILE, TILE_WIDTH, LOT = 16, 2048, 4096
#: edits permitted in 100 positions of the longer sequence
EDITS_PER_100 = 8
#: length of the anchors of the quick search for a moved stretch
ANCHOR = 11
#: pairs whose moves are searched together
MOVED_CHUNK = 512

_CODES = np.arange(256, dtype=np.uint64) + np.uint64(4)
for _i, _c in enumerate("ACGT"):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _i


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bases of a string column and each row's first position (and the end)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return _CODES[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def _grams(codes: np.ndarray, q: int, base: int = 5) -> np.ndarray:
    n = max(codes.size - q + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(base) + codes[k : k + n]
    return h


def _band(features: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(features, 1))).astype(np.int64)


def _sign(parts: int, large: int = LARGE):
    """Rows (rep, block, seq): rows (sig, rep, len, salt).

    Members of a signature that is hot in a batch get a salt, and a row with rep -1, len -1 and salt 0 tells that it is.
    """

    def one_band(band: np.ndarray, row_of: np.ndarray, mixed: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        domain = np.maximum(np.ceil(1.5 * 2.0 ** band[row_of] / FEATURES_PER_PART), parts).astype(np.uint64)
        part = ((mixed >> np.uint64(32)) * domain) >> np.uint64(32)
        use = part < parts
        key = row_of[use].astype(np.uint64) * np.uint64(parts) + part[use]
        both = np.unique((key << np.uint64(40)) | (mixed[use] & np.uint64(2**40 - 1)))
        key = both >> np.uint64(40)
        if not key.size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        content = np.add.reduceat(_mix(both & np.uint64(2**40 - 1)), first)
        key = key[first]
        row = (key // np.uint64(parts)).astype(np.int64)
        return row, _mix(content ^ _mix(key % np.uint64(parts) + np.uint64(1)) ^ salt[row] ^ _mix(band[row].astype(np.uint64) + np.uint64(1000)))

    def short_bands(codes: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts of a band and those that one of its texts may be a longer version of."""
        for b, (least, q) in enumerate(SHORT_FEATURES):
            most = SHORT_FEATURES[b - 1][0] if b else SHORT
            inside = (sizes >= least) & (sizes < most * 1.1)
            if not inside.any():
                continue
            grams = _grams(codes, q)
            row_of = np.repeat(np.arange(sizes.size), sizes)[: grams.size]
            use = inside[row_of] & (np.arange(grams.size) + q <= offsets[1:][row_of])
            band = np.full(sizes.size, int(np.log2(least)))
            yield one_band(band, row_of[use], _mix(grams[use]), salt ^ np.uint64(q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, offsets = _flat(batch.column("seq"))
            sizes = np.diff(offsets)
            grams = _grams(codes, Q)
            row_of = np.repeat(np.arange(batch.num_rows), np.maximum(sizes, 0))[: grams.size]
            inside = np.arange(grams.size) + Q <= offsets[1:][row_of] if grams.size else np.zeros(0, bool)
            inside &= (sizes >= SHORT)[row_of]
            blocks = batch.column("block").dictionary_encode()
            salt = np.array([hash_text(t) for t in blocks.dictionary.to_pylist()], np.uint64)[blocks.indices.to_numpy()]
            row_of, mixed = row_of[inside], _mix(grams[inside])
            features = np.maximum(sizes - Q + 1, 0)
            own, longer = _band(features), _band(features * 1.1)
            parts_of = [one_band(own, row_of, mixed, salt), *short_bands(codes, offsets, sizes, salt)]
            edge = (longer != own)[row_of]
            if edge.any():
                parts_of.append(one_band(longer, row_of[edge], mixed[edge], salt))
            # the shortest texts sign themselves: they may not be edited, only moved
            short = np.flatnonzero(sizes < SHORT_FEATURES[-1][0])
            if short.size:
                texts = batch.column("seq").take(pa.array(short)).to_pylist()
                own_letters = np.array([hash_text("".join(sorted(t))) for t in texts], np.uint64)
                parts_of.append((short, own_letters ^ salt[short]))
            row = np.concatenate([p[0] for p in parts_of])
            sig = np.concatenate([p[1] for p in parts_of]).view(np.int64)
            rep = batch.column("rep").to_numpy()[row]
            size = np.asarray(pa.compute.utf8_length(batch.column("seq"))).astype(np.int32)[row]
            values, at, count = np.unique(sig, return_inverse=True, return_counts=True)
            hot = count > large
            spread = np.where(hot[at], 1 + (_mix(rep.astype(np.uint64)) % np.uint64(SALTS - 1)).astype(np.int32), 0).astype(np.int32)
            told = int(hot.sum())
            arrays = [np.concatenate((sig, values[hot])), np.concatenate((rep, np.full(told, -1, np.int64))), np.concatenate((size, np.full(told, -1, np.int32))), np.concatenate((spread, np.zeros(told, np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["sig", "rep", "len", "salt"])

    return run


def hash_text(text: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest((text or "").encode())


_PAIRS = "a long, b long, sig long, len int"


def _pair_buckets(large: int):
    """Rows (sig, rep, len, salt) sorted by sig: pairs (a, b) of small buckets; members of hot ones come out with b null.

    A bucket is hot if it has more than ``large`` members here or a salt or a row without a length says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(sig: np.ndarray, rep: np.ndarray, size: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            count = np.diff(np.append(first, sig.size))
            is_hot = np.repeat((count > large) | np.logical_or.reduceat((salt > 0) | (size < 0), first), count)
            ia, ib = [], []
            at = np.arange(sig.size)
            left = np.repeat(first + count, count) - at - 1  # members that follow in the bucket
            left[is_hot] = 0
            for step in range(1, int(left.max(initial=0)) + 1):
                i = np.flatnonzero(left >= step)
                ia.append(i)
                ib.append(i + step)
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ia, ib))
            top, low = np.maximum(size[i], size[j]), np.minimum(size[i], size[j])
            ok = (100 * (top - low) <= EDITS_PER_100 * top) & (rep[i] != rep[j])
            a, b = np.minimum(rep[i[ok]], rep[j[ok]]), np.maximum(rep[i[ok]], rep[j[ok]])
            pair = np.unique(np.stack((a, b)), axis=1) if a.size else np.zeros((2, 0), np.int64)
            hot = is_hot & (size >= 0)
            n = int(hot.sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((pair[0], rep[hot]))),
                    pa.concat_arrays([pa.array(pair[1]), pa.nulls(n, pa.int64())]),
                    pa.concat_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(sig[hot])]),
                    pa.concat_arrays([pa.nulls(pair.shape[1], pa.int32()), pa.array(size[hot].astype(np.int32))]),
                ],
                names=["a", "b", "sig", "len"],
            )

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in ("sig", "rep", "len", "salt")]
            held = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)] if held else cols
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last == 0 and held[0].size <= large:
                continue
            if last == 0:  # one hot bucket fills everything held: its rows can go, all but enough to know it again
                yield _hot_rows(held, large + 1)
                held = [h[: large + 1] for h in held]
                continue
            yield pairs_of(*(h[:last] for h in held))
            held = [h[last:] for h in held]
        if held:
            yield pairs_of(*held)

    return run


def _hot_rows(held: list[np.ndarray], start: int) -> pa.RecordBatch:
    sig, rep, size, _ = (h[start:][held[2][start:] >= 0] for h in held)
    return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(rep.size, pa.int64()), pa.array(sig), pa.array(size.astype(np.int32))], names=["a", "b", "sig", "len"])


def _gram_bits(column: pa.Array, q: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the bits of its grams of ``q``, as (word, text), and their number."""
    words, count = [], []
    step = max(2**23 // bits, 1)
    for at in range(0, len(column), step):
        some = column.slice(at, step)
        codes, offsets = _flat(some)
        grams = _grams(codes, q, 4)  # grams of A, C, G and T that have a bit of their own tell more than digests do
        row_of = np.repeat(np.arange(len(some)), np.diff(offsets))[: grams.size]
        real = np.arange(grams.size) + q <= offsets[1:][row_of]
        flags = np.zeros((len(some), bits), bool)
        flags[row_of[real], (grams[real] % np.uint64(bits)).astype(np.int64)] = True
        words.append(np.packbits(flags, axis=1, bitorder="little").view(np.uint64))
        count.append(flags.sum(1))
    return np.concatenate(words).T.copy(), np.concatenate(count)


def _may_be_near(words: np.ndarray, others: np.ndarray, most: np.ndarray, longer: np.ndarray, q: int, edits_per_100: int = EDITS_PER_100, wide: int = 1) -> np.ndarray:
    """Whether texts share enough gram bits; never false for near ones.

    An edit breaks at most ``q`` grams of a text, a move (three joints) 3 * (q - 1); ``most`` is the larger number of bits.
    Grams are of bytes: an edit of a letter of up to four bytes breaks twice as many (``wide``).
    """
    return np.bitwise_count(words & others).sum(0, dtype=np.uint16) >= most - _broken(longer, q, wide, edits_per_100)


def _broken(longer: np.ndarray, q: int, wide: int = 1, edits_per_100: int = EDITS_PER_100) -> np.ndarray:
    return longer * edits_per_100 // 100 * q * wide + 3 * (q - 1)


def _set_bits(column: pa.Array) -> np.ndarray:
    """Lists of numbers as bits, (word, list): two lists have a number in common where their bits do."""
    row_of = np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).to_numpy())
    values, at = np.unique(column.flatten().to_numpy(), return_inverse=True)
    out = np.zeros((values.size // 64 + 1, len(column)), np.uint64)
    np.bitwise_or.at(out, (at // 64, row_of), np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, i, j, blk, rep, len, seq, shared), sorted by the first three: pairs of different blocks, or within one if i = j,
    that have one of their signatures ``shared`` in common and may be near.
    """

    def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.take(pa.compute.sort_indices(table, [("len", "ascending")])).combine_chunks()
        rep, size, blk = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "len", "blk"))
        seq = table.column("seq").combine_chunks()
        wide = 1 if pa.compute.sum(pa.compute.binary_length(seq)).as_py() == int(size.sum()) else 2
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        if not left.size or not right.size:
            return
        sieves = []
        for q, number in SHARED_GRAMS:
            words, bits = _gram_bits(seq, q, number)
            sieves.append((q, words[:, left], bits[left], words[:, right], bits[right]))
        signs = _set_bits(table.column("shared").combine_chunks())
        signs, own_signs = signs[:, right], signs[:, left]
        rep_l, size_l, rep, size = rep[left], size[left], rep[right], size[right]
        # both sides ascend by length: those of fitting length are a range
        start = np.arange(left.size) + 1 if i == j else np.searchsorted(size, -(-size_l * (100 - EDITS_PER_100) // 100))
        end = np.searchsorted(size, size_l * 100 // (100 - EDITS_PER_100), "right")
        found: list[np.ndarray] = []
        held = 0
        for x in range(left.size):
            fit = np.arange(start[x], max(end[x], start[x]))
            for k, (q, words_l, bits_l, words, bits) in enumerate(sieves):
                some = words[:, start[x] : end[x]] if k == 0 else words[:, fit]
                ok = _may_be_near(some, words_l[:, [x]], np.maximum(bits[fit], bits_l[x]), np.maximum(size[fit], size_l[x]), q, wide=wide)
                fit = fit[ok]
            fit = fit[(rep[fit] != rep_l[x]) & (signs[:, fit] & own_signs[:, [x]]).any(0)]
            found.append(np.stack((np.minimum(rep[fit], rep_l[x]), np.maximum(rep[fit], rep_l[x]))))
            held += fit.size
            if held > 50_000 or x == left.size - 1:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                found, held = [], 0

    rest: list[pa.Table] = []
    seen = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = np.stack([table.column(c).to_numpy() for c in ("sig", "i", "j")])
        cuts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0)))) if table.num_rows else []
        for a, z in zip(cuts, np.append(cuts[1:], table.num_rows) if len(cuts) else [], strict=True):
            key = tuple(keys[:, a])
            if rest and key != seen:
                yield from pairs_of(pa.concat_tables(rest))
                rest = []
            seen = key
            rest.append(table.slice(a, z - a))
    if rest:
        yield from pairs_of(pa.concat_tables(rest))


# --- whole blocks ----------------------------------------------------------------------------


def _windows(task: np.ndarray, side: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, of rows sorted by task, side and size, the range of rows it is compared with: those of fitting length.

    Side 0 is compared within itself, side 1 with side 2 of its task.
    """
    at = np.arange(task.size)
    new = np.concatenate(([True], (task[1:] != task[:-1]) | (side[1:] != side[:-1])))
    part = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    follows = np.append((task[first[1:]] == task[first[:-1]]) & (side[first[:-1]] == 1), False)
    met = part + (side == 1)
    key, base = part * 2**32 + size, met * 2**32
    low = np.where(side == 0, at + 1, np.searchsorted(key, base - (-size * (100 - EDITS_PER_100) // 100)))
    high = np.searchsorted(key, base + size * 100 // (100 - EDITS_PER_100), "right")
    none = (side == 2) | ((side == 1) & ~follows[part])
    return np.where(none, 0, low), np.where(none, 0, high)


def _sieved(seq: pa.Array, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of texts, j in the range of i, that share as many grams as near ones must and aren't of too different letters."""
    open_ = high > low
    longest = np.maximum(size, size[np.maximum(high, 1) - 1])
    least = -1
    for most, q in GRAMS_BY_LENGTH:
        mine = open_ & (longest > least) & (longest <= most)
        least = most
        if not mine.any():
            continue
        # only these texts and those they meet
        met = mine | (np.cumsum(np.bincount(low[mine], minlength=size.size + 1) - np.bincount(high[mine], minlength=size.size + 1))[:-1] > 0)
        number = np.append(0, np.cumsum(met))
        some, rows = np.flatnonzero(met), np.flatnonzero(mine)
        for i, j in _sieved_by(q, seq.take(pa.array(some)), size[some], number[rows], number[low[rows]], number[high[rows]]):
            yield some[i], some[j]


def _sieved_by(q: int, seq: pa.Array, size: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same by grams of ``q``, for the texts ``of``, whose ranges are given."""
    wide = 1 if pa.compute.sum(pa.compute.binary_length(seq)).as_py() == int(size.sum()) else 2
    words, bits = _gram_bits(seq, q, 4**q)
    codes, offsets = _flat(seq)
    row_of = np.repeat(np.arange(len(seq)), np.diff(offsets))
    letters = np.stack([np.bincount(row_of[codes == c], minlength=len(seq)) for c in range(4)])
    letters = np.concatenate((letters, size - letters.sum(0, keepdims=True)))
    kind = np.uint8 if bits.max(initial=0) < 256 else np.int32
    room = [np.empty(TILE * TILE_WIDTH, x) for x in (np.uint64, np.uint8, kind)]
    for t in range(0, of.size, TILE):
        rows, first, past = of[t : t + TILE], low[t : t + TILE], high[t : t + TILE]
        own = words[:, rows, None]
        for start in range(first.min(), past.max(), TILE_WIDTH):
            end = min(start + TILE_WIDTH, past.max())
            both, count, shared = (x[: rows.size * (end - start)].reshape(rows.size, -1) for x in room)
            shared[:] = 0
            for w, o in zip(words, own, strict=True):
                np.bitwise_and(o, w[start:end], out=both)
                np.add(shared, np.bitwise_count(both, out=count), out=shared)
            # no more than any text of the tile needs, then what the very pair needs
            need = np.maximum(bits[start:end], bits[rows].min()) - _broken(np.maximum(size[start:end], size[rows].max()), q, wide)
            x, j = np.nonzero(shared >= np.clip(need, 0, np.iinfo(kind).max).astype(kind))
            i, j, common = rows[x], j + start, shared[x, j].astype(np.int64)
            top = np.maximum(size[i], size[j])
            ok = (j >= first[x]) & (j < past[x]) & (common >= np.maximum(bits[i], bits[j]) - _broken(top, q, wide))
            # an edit changes two counts of letters by one at most, a move none
            ok &= np.abs(letters[:, i] - letters[:, j]).sum(0) <= 2 * (top * EDITS_PER_100 // 100)
            yield i[ok], j[ok]


def _near_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, rep, len, seq), sorted by task, side and len: links (a, b) between near texts, a < b."""

    def links_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        task, side, rep, size = (table.column(c).to_numpy().astype(np.int64) for c in ("task", "side", "rep", "len"))
        seq = table.column("seq").cast(pa.large_string()).combine_chunks()
        held: list[np.ndarray] = []

        def verified() -> Iterator[pa.RecordBatch]:
            i, j = np.concatenate(held, axis=1)
            held.clear()
            for at in range(0, i.size, LOT):
                one, two = i[at : at + LOT], j[at : at + LOT]
                ok = near(seq.take(pa.array(one)).to_pylist(), seq.take(pa.array(two)).to_pylist())
                a, b = rep[one[ok]], rep[two[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for i, j in _sieved(seq, size, *_windows(task, side, size)):
            other = rep[i] != rep[j]
            held.append(np.stack((i[other], j[other])))
            if sum(h.shape[1] for h in held) >= LOT:
                yield from verified()
        if held:
            yield from verified()

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        last = batch.column("task")[-1].as_py()
        if sum(b.nbytes for b in rest) < PIECE[0] or rest[0].column("task")[0].as_py() == last:
            continue
        table = pa.Table.from_batches(rest)
        cut = int(np.searchsorted(table.column("task").to_numpy(), last))  # the last task may go on
        yield from links_of(table.slice(0, cut))
        rest = table.slice(cut).to_batches()
    if rest:
        yield from links_of(pa.Table.from_batches(rest))


# --- verification ----------------------------------------------------------------------------


_PAD = np.uint32(0xFFFFFFFF)


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one text a row, and the texts' lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), max(int(size.max(initial=0)), 1)), _PAD, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def edit_distances(left: list[str], right: list[str], chunk: int = 4096) -> np.ndarray:
    """Levenshtein distances of many pairs at once: bit-parallel columns, 64 rows to a word."""
    out = np.zeros(len(left), np.int64)
    words = np.array([(max(min(len(a), len(b)), 1) + 63) // 64 for a, b in zip(left, right, strict=True)], np.int64)
    for w in np.unique(words):
        members = np.flatnonzero(words == w)
        for at in range(0, members.size, chunk):
            some = members[at : at + chunk]
            pairs = [(left[k], right[k]) if len(left[k]) <= len(right[k]) else (right[k], left[k]) for k in some]
            out[some] = _columns([p for p, _ in pairs], [t for _, t in pairs], int(w))
    return out


def _columns(patterns: list[str], texts: list[str], words: int) -> np.ndarray:
    pat, m = _matrix(patterns)
    txt, n = _matrix(texts)
    top = max(int(x[x != _PAD].max(initial=0)) for x in (pat, txt))
    symbols = np.flatnonzero(np.bincount(pat[pat != _PAD], minlength=top + 1) + np.bincount(txt[txt != _PAD], minlength=top + 1)).astype(np.uint32)
    count = len(patterns)
    if symbols.size > 200 and count > 1:  # a table per symbol: large alphabets go in smaller lots
        half = count // 2
        return np.concatenate((_columns(patterns[:half], texts[:half], words), _columns(patterns[half:], texts[half:], words)))
    lut = np.zeros(top + 2, np.int64)
    lut[symbols] = np.arange(symbols.size)
    lut[top + 1] = symbols.size  # the end of a text
    wide = np.full((count, words * 64), _PAD, np.uint32)
    wide[:, : pat.shape[1]] = pat[:, : words * 64]
    eq = np.zeros((symbols.size + 1, words, count), np.uint64)
    for s, symbol in enumerate(symbols):
        eq[s] = np.packbits(wide == symbol, axis=1, bitorder="little").view(np.uint64).T
    pv = np.full((words, count), np.iinfo(np.uint64).max, np.uint64)
    mv = np.zeros((words, count), np.uint64)
    score = m.copy()
    last = np.uint64(1) << ((np.maximum(m, 1) - 1) % 64).astype(np.uint64)
    one, last_bit = np.uint64(1), np.uint64(63)
    rows = np.arange(count)
    columns = lut[np.minimum(txt, top + 1)]
    for j in range(int(n.max(initial=0))):
        e = eq[columns[:, j], :, rows]
        plus = np.ones(count, np.uint64)
        minus = np.zeros(count, np.uint64)
        for w in range(words):
            x, p, q = e[:, w], pv[w], mv[w]
            xv = x | q
            x = x | minus
            xh = (((x & p) + p) ^ p) | x
            ph = q | ~(xh | p)
            mh = p & xh
            if w == words - 1:
                live = j < n
                score += live & ((ph & last) != 0)
                score -= live & ((mh & last) != 0)
            nplus, nminus = ph >> last_bit, mh >> last_bit
            ph = (ph << one) | plus
            mh = (mh << one) | minus
            pv[w] = mh | ~(xv | ph)
            mv[w] = ph & xv
            plus, minus = nplus, nminus
    return np.where(m == 0, n, score)


def moved_back(a: str, b: str) -> list[str]:
    """Versions of ``a`` with one contiguous stretch put where ``b`` has it; [] if none shows in the common anchors."""
    at: dict[str, int] = {}
    for i in range(len(a) - ANCHOR + 1):
        gram = a[i : i + ANCHOR]
        at[gram] = -1 if gram in at else i
    runs: list[list[int]] = []  # [start in a, end in a, start in b, end in b], in the order of b
    for j in range(len(b) - ANCHOR + 1):
        i = at.get(b[j : j + ANCHOR], -1)
        if i < 0:
            continue
        if runs and abs((j - i) - (runs[-1][3] - runs[-1][1])) <= 3 and i + ANCHOR > runs[-1][1]:
            runs[-1][1], runs[-1][3] = i + ANCHOR, j + ANCHOR
        else:
            runs.append([i, i + ANCHOR, j, j + ANCHOR])
    found: set[str] = set()
    for t in range(len(runs) - 1):
        if runs[t + 1][0] >= runs[t][0]:
            continue
        start = runs[t + 1][0]
        moved = [r for r in runs[: t + 1] if r[0] > start]
        before = [r for r in runs[: t + 1] if r[0] <= start]
        y1 = min(r[0] for r in moved)
        stay = [r for r in runs[t + 1 :] if r[0] < y1]
        after = [r for r in runs[t + 1 :] if r[0] > y1]
        xs = {start, before[-1][1] if before else 0}
        ys = {y1, max(r[1] for r in stay)}
        zs = {max(r[1] for r in moved), after[0][0] if after else len(a)}
        found.update(a[:x] + a[y:z] + a[x:y] + a[z:] for x in xs for y in ys for z in zs if x < y < z)
    return sorted(found)


def _window_costs(left: list[str], right: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of every whole window of ``length`` of the left texts within the right one, by the end there.

    Returns each window's pair, its number in its text and the costs (window, end in the right text).
    """
    owner = np.repeat(np.arange(len(left)), [len(t) // length for t in left])
    number = np.concatenate([np.arange(len(t) // length) for t in left]) if left else owner
    pat, _ = _matrix([left[k][w * length : (w + 1) * length] for k, w in zip(owner.tolist(), number.tolist(), strict=True)])
    txt, n = _matrix(right)
    symbols = np.unique(pat)
    eq = np.zeros((owner.size, symbols.size + 1), np.uint64)
    at = np.arange(owner.size)
    for i in range(length if owner.size else 0):
        eq[at, np.searchsorted(symbols, pat[:, i])] |= np.uint64(1 << i)
    column = np.searchsorted(symbols, txt)
    column[np.isin(txt, symbols, invert=True)] = symbols.size  # met in no window, or past the end
    pv, mv = np.full(owner.size, (1 << length) - 1, np.uint64), np.zeros(owner.size, np.uint64)
    last, one = np.uint64(1 << (length - 1)), np.uint64(1)
    costs = np.full((owner.size, txt.shape[1] + 1), length, np.int16)
    for j in range(txt.shape[1] if owner.size else 0):
        e = eq[at, column[owner, j]]
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        costs[:, j + 1] = costs[:, j] + ((ph & last) != 0) - ((mh & last) != 0)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    past = np.arange(txt.shape[1] + 1) > n[owner][:, None]
    costs[past] = length
    return owner, number, costs


def _all_cells(lengths: np.ndarray, g: int) -> np.ndarray:
    """Cells (pair, x, y, z) of size ``g``, x <= y <= z, that some joints of a text may lie in."""
    x, y, z = (c.ravel() for c in np.meshgrid(*[np.arange(int(lengths.max()) // g + 1)] * 3, indexing="ij"))
    use = (x <= y) & (y <= z)
    pair, cell = np.nonzero(z[use][None, :] * g <= lengths[:, None])
    return np.stack((pair, *(c[use][cell] * g for c in (x, y, z))))


def _may_hold(left: list[str], right: list[str], allowed: np.ndarray, cells: np.ndarray, g: int) -> np.ndarray:
    """Which cells (pair, x, y, z) of size ``g`` may hold a move that leaves ``allowed`` edits; never false for one that does.

    Windows that hold no joint cost at least what they cost near the diagonal of their piece: the front and the end stay,
    the pieces change places.
    """
    if not 8 <= g <= 32 or not cells.shape[1]:
        return np.ones(cells.shape[1], bool)
    pair, x, y, z = cells[0], *(cells[1:] // g)
    deep = max(len(t) for t in left) // g + 1
    owner, number, costs = _window_costs(left, right, g)
    most = int(allowed.max())

    def summed(shift: int, reach: int) -> np.ndarray:
        """Sums of the costs of the windows before each, if they move by about ``shift``."""
        ends = (number + 1)[:, None] * g + shift + np.arange(-reach, reach + 1)
        real = (ends >= 0) & (ends < costs.shape[1])
        least = np.where(real, np.take_along_axis(costs, np.clip(ends, 0, costs.shape[1] - 1), 1), g).min(1)
        table = np.zeros((len(left), deep + 3), np.int64)
        table[owner, number + 1] = least
        return np.cumsum(table, axis=1)

    stay = summed(0, most)
    bound = stay[pair, x] + stay[pair, -1] - stay[pair, z + 1]
    forward, back = (np.stack([summed(sign * c * g, g + most) for c in range(deep + 1)]) for sign in (1, -1))
    bound += forward[z - y, pair, np.maximum(y, x + 1)] - forward[z - y, pair, x + 1]
    bound += back[y - x, pair, np.maximum(z, y + 1)] - back[y - x, pair, y + 1]
    return bound <= allowed[pair]


def any_move_near(left: list[str], right: list[str], allowed: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Whether some contiguous stretch of ``left`` put elsewhere brings the pair within ``allowed`` edits. Exact.

    A move swaps the neighbours [x, y) and [y, z). Cells of (x, y, z) that their windows don't exclude are halved as
    long as the distance at their centre doesn't exclude them. ``plain`` is the distance without a move: a swap of
    s and t bases changes it by 2 * min(s, t) at most.
    """
    ok = np.zeros(len(left), bool)
    lengths = np.array([len(t) for t in left], np.int64)
    for at in range(0, len(left), MOVED_CHUNK):
        some = np.arange(at, min(at + MOVED_CHUNK, len(left)))
        size = lengths[some]
        wide = 2 ** np.floor(np.log2(np.maximum(size / 9, 1))).astype(np.int64)
        for g in sorted(set(wide.tolist()), reverse=True):
            members = some[wide == g]
            own_left, own_right = [left[k] for k in members], [right[k] for k in members]
            number = np.full(len(left), -1)
            number[members] = np.arange(members.size)

            def open_(cells: np.ndarray, g: int, number=number, own_left=own_left, own_right=own_right, members=members) -> np.ndarray:
                local = np.stack((number[cells[0]], *cells[1:]))
                return cells[:, _may_hold(own_left, own_right, allowed[members], local, g)]

            cell = _all_cells(lengths[members], g)
            cell[0] = members[cell[0]]
            cell = open_(cell, g)
            while cell.shape[1]:
                owner, x, y, z = cell
                n = lengths[owner]
                most = np.minimum(np.minimum(y + g - 1, n) - x, np.minimum(z + g - 1, n) - y)
                gain = plain[owner] - allowed[owner]
                cell = cell[:, (most > 0) & (2 * most >= gain) & (z <= n) & ~ok[owner]]
                kept = []
                for part in range(0, cell.shape[1], 20_000):
                    piece = cell[:, part : part + 20_000]
                    piece = piece[:, ~ok[piece[0]]]
                    if not piece.shape[1]:
                        continue
                    owner = piece[0]
                    n = lengths[owner]
                    cuts = np.minimum(np.sort(piece[1:] + g // 2, axis=0), n)
                    versions = [left[k][:x] + left[k][y:z] + left[k][x:y] + left[k][z:] for k, x, y, z in zip(owner.tolist(), *cuts.tolist(), strict=True)]
                    distance = edit_distances(versions, [right[k] for k in owner])
                    ok[owner[distance <= allowed[owner]]] = True
                    # each joint lies within g / 2 of its place in the centre
                    kept.append(piece[:, distance <= allowed[owner] + 3 * g])
                if g == 1 or not kept:
                    break
                g //= 2
                cell = np.concatenate(kept, axis=1)
                halves = [(i, j, k) for i in (0, g) for j in (0, g) for k in (0, g)]
                cell = np.concatenate([cell + np.array([0, *h])[:, None] for h in halves], axis=1)
                cell = open_(cell[:, (cell[1] <= cell[2]) & (cell[2] <= cell[3]) & (cell[3] <= lengths[cell[0]]) & ~ok[cell[0]]], g)
    return ok


def _may_be_moved(a: str, b: str, allowed: int) -> bool:
    """Whether the texts share enough grams of some lengths; never false for texts that ``allowed`` edits and one move part.

    An edit breaks at most q grams of a text, a move (three joints) 3 * (q - 1).
    """
    for q in (7, 6, 5, 4, 3):
        one, two = ({s[i : i + q] for i in range(len(s) - q + 1)} for s in (a, b))
        if len(one & two) < max(len(one), len(two)) - allowed * q - 3 * (q - 1):
            return False
    return True


def near(left: list[str], right: list[str], edits_per_100: int = EDITS_PER_100) -> np.ndarray:
    """Whether each pair is within the permitted edits, directly or with one stretch moved back."""
    allowed = np.array([max(len(a), len(b)) * edits_per_100 // 100 for a, b in zip(left, right, strict=True)], np.int64)
    plain = edit_distances(left, right)
    ok = plain <= allowed
    open_ = np.flatnonzero(~ok)
    if not open_.size:
        return ok
    open_ = open_[[_may_be_moved(left[k], right[k], int(allowed[k])) for k in open_]]
    # a swap can bring lengths no closer
    open_ = open_[[abs(len(left[k]) - len(right[k])) <= allowed[k] for k in open_]] if open_.size else open_
    owner, first, second = [], [], []
    for k in open_:
        # anchors may break differently from either side
        for a, b in ((left[k], right[k]), (right[k], left[k])):
            versions = moved_back(a, b)
            owner += [k] * len(versions)
            first += versions
            second += [b] * len(versions)
    if owner:
        hit = edit_distances(first, second) <= allowed[owner]
        ok[np.array(owner)[hit]] = True
    rest = open_[~ok[open_]]
    if rest.size:
        ok[rest] = any_move_near([left[k] for k in rest], [right[k] for k in rest], allowed[rest], plain[rest])
    return ok


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.filter(pa.array(_share_grams(batch.column("seq_a"), batch.column("seq_b"))))
        keep = pa.array(near(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist()), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _share_grams(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether pairs of texts share as many grams as near ones must; much cheaper than distances, and never false for near ones."""
    q, number = SHARED_GRAMS[-1]
    out = []
    for at in range(0, len(left), 2048):
        one, two = left.slice(at, 2048), right.slice(at, 2048)
        (words, bits), (others, more) = (_gram_bits(side, q, number) for side in (one, two))
        sizes = [np.asarray(pa.compute.utf8_length(side)).astype(np.int64) for side in (one, two)]
        wide = 1 if all(pa.compute.sum(pa.compute.binary_length(side)).as_py() == int(n.sum()) for side, n in zip((one, two), sizes, strict=True)) else 2
        out.append(_may_be_near(words, others, np.maximum(bits, more), np.maximum(*sizes), q, wide=wide))
    return np.concatenate(out)


# --- plan ------------------------------------------------------------------------------------


def candidate_pairs(reps: DataFrame, *, parts: int = PARTS, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows of ``reps`` (rep, block, seq) that share a signature; of a hot one those that may be near."""
    signed = reps.select("rep", "block", "seq").mapInArrow(_sign(parts, large), "sig long, rep long, len int, salt int")
    first = materialise(signed.repartition("sig", "salt").sortWithinPartitions("sig").mapInArrow(_pair_buckets(large), _PAIRS), "buckets")
    found = [first.where("b is not null").select("a", "b")]
    hot = first.where("b is null").select(F.col("a").alias("rep"), "sig")
    if not hot.isEmpty():
        found.append(_hot_buckets(hot, reps, block).mapInArrow(_block_pairs, "a long, b long"))
    return reduce(DataFrame.unionByName, found).distinct()


def _hot_buckets(hot: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """Rows of ``_block_pairs`` from the members (rep, sig) of hot signatures: a bucket for each signature, one for all wide ones of a block.

    A signature is wide if one in ``WIDE`` of the block's texts with hot signatures has it. That only saves comparing and sending texts again.
    """
    own = hot.groupBy("rep").agg(F.collect_set("sig").alias("sigs"))
    texts = materialise(own.join(reps.select("rep", "block", "seq"), "rep"), "hot")
    number = texts.groupBy("block").agg(F.count("*").alias("texts"))
    met = texts.select("block", F.explode("sigs").alias("sig")).groupBy("block", "sig").agg(F.count("*").alias("n"))
    wide = materialise(met.join(number, "block").where(F.col("n") * WIDE >= F.col("texts")).groupBy("block").agg(F.collect_list("sig").alias("wide")), "wide")
    both = texts.join(wide, "block", "left").withColumn("wide", F.coalesce("wide", F.array().cast("array<bigint>")))
    family = F.array(F.struct(F.xxhash64("block").alias("sig"), F.array_intersect("sigs", "wide").alias("shared")))
    alone = F.transform(F.array_except("sigs", "wide"), lambda s: F.struct(s.alias("sig"), F.array(s).alias("shared")))
    keyed = both.withColumn("_k", F.explode(F.filter(F.concat(family, alone), lambda k: F.size(k["shared"]) > 0)))
    keyed = keyed.select("rep", F.length("seq").alias("len"), "seq", "_k.sig", "_k.shared")
    blocks = materialise(keyed.groupBy("sig").agg(F.ceil(F.count("*") / block).alias("_blocks")), "blocks")
    marked = keyed.join(blocks, "sig").withColumn("blk", F.pmod(F.hash("rep"), F.col("_blocks")).cast("long"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, "blk").alias("i"), F.greatest(o, "blk").alias("j")))
    spread = marked.withColumn("_p", F.explode(others)).select("sig", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "blk", "rep", "len", "seq", "shared")
    return spread.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")


def _whole_links(reps: DataFrame, piece: int | None) -> DataFrame:
    """Links (a, b) among all texts of each block of ``reps`` (rep, block, seq).

    A block is cut into pieces of so many letters by length, texts of one length at random; every two pieces whose lengths can meet are a task.
    """
    texts = reps.select("rep", "block", "seq", F.length("seq").alias("len"))
    lengths = texts.groupBy("block", "len").agg(F.count("*").alias("n"))
    least, most = PIECE
    letters = F.col("n") * F.col("len")
    of_piece = F.lit(piece) if piece else F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.sum(letters).over(Window.partitionBy("block")) / PIECES)))
    before = F.sum(letters).over(Window.partitionBy("block").orderBy("len")) - letters
    lengths = materialise(lengths.select("block", "len", "n", before.alias("before"), of_piece.cast("long").alias("piece")), "lengths")
    number = lambda k: F.floor((F.col("before") + k * F.col("len")) / F.col("piece"))
    pieces = lengths.select("block", "len", F.explode(F.sequence(number(F.lit(0)), number(F.col("n") - 1))).alias("i"))
    pieces = pieces.groupBy("block", "i").agg(F.min("len").alias("low"), F.max("len").alias("high"))
    others = pieces.select("block", F.col("i").alias("j"), F.col("low").alias("other"))
    meet = (F.col("i") <= F.col("j")) & (F.col("other") * (100 - EDITS_PER_100) <= F.col("high") * 100)
    tasks = materialise(pieces.join(others, "block").where(meet).select("block", "i", "j", F.monotonically_increasing_id().alias("task")), "tasks")
    own = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("number"), F.lit(0).alias("side"))))
    both = F.array(F.struct(F.col("i").alias("number"), F.lit(1).alias("side")), F.struct(F.col("j").alias("number"), F.lit(2).alias("side")))
    sides = tasks.select("block", "task", F.explode(F.coalesce(own, both)).alias("_s")).groupBy("block", F.col("_s.number").alias("number")).agg(F.collect_list(F.struct("task", "_s.side")).alias("_in"))
    placed = texts.join(lengths, ["block", "len"]).withColumn("number", number(F.pmod(F.xxhash64("rep"), F.col("n"))))
    sent = placed.join(sides, ["block", "number"]).select(F.explode("_in").alias("_t"), "rep", "len", "seq").select("_t.task", "_t.side", "rep", "len", "seq")
    # tasks are heavy for their bytes: as many partitions as are wanted, not as few as fit
    wanted = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * reps.sparkSession.sparkContext.defaultParallelism)
    return sent.repartition(wanted, "task").sortWithinPartitions("task", "side", "len").mapInArrow(_near_in_tasks, "a long, b long").distinct()


def near_pairs(df: DataFrame, rec_id: str, block: str, seq: str, *, piece: int | None = None, parts: int = PARTS, large: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) of the distinct texts, links (a, b) between near representatives.

    Near means: same ``block``, and at most 8 edits in 100 positions of the longer text, letter case
    aside, directly or once one contiguous stretch is put back in its place. All near pairs are found,
    unless ``large`` (members of a hot signature) is given: then those with one of ``parts`` signatures in common.

    Rows with a null id, block or text belong nowhere and are left out. Copies share one
    representative (their smallest id) and are compared once. Empty texts are copies of each other.
    Letters other than A, C, G, T are ordinary symbols. An id that comes again with another text is a
    member of both. Empty tables give empty results; other columns aren't read. ``piece`` is the number of letters in a
    piece of a block and changes no result.
    """
    rows = df.select(F.col(rec_id).cast("long").alias("id"), F.col(block).cast("string").alias("block"), F.upper(F.col(seq)).alias("seq")).dropna()
    reps = materialise(rows.groupBy("block", "seq").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "texts")
    members = rows.join(reps.where("copies > 1").select("block", "seq", "rep"), ["block", "seq"]).select("id", "rep").distinct()
    if large is None:
        return members, materialise(_whole_links(reps, piece), "links")
    pairs = candidate_pairs(reps, parts=parts, large=large)
    text = reps.select("rep", "seq")
    met = pairs.join(text.select(F.col("rep").alias("a"), F.col("seq").alias("seq_a")), "a").join(text.select(F.col("rep").alias("b"), F.col("seq").alias("seq_b")), "b")
    links = materialise(met.select("a", "b", "seq_a", "seq_b").mapInArrow(_verify, "a long, b long"), "links")
    return members, links


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of ids (id_a < id_b) behind links and copies. ``members`` holds texts with copies only."""
    one = members.select(F.col("rep").alias("a"), F.col("id").alias("id_a"))
    two = members.select(F.col("rep").alias("b"), F.col("id").alias("id_b"))
    pairs = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"))
    copies = one.join(two, F.col("a") == F.col("b")).where("id_a < id_b").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    return pairs.unionByName(copies).where("x != y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    """A digest of a set of edges, by partial sums."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, class) with class the smallest node reachable over ``links`` (a, b), by alternating star contraction.

    Each round is one shuffle by node with partial aggregation; the state is written between rounds,
    and only a digest of it comes to the driver.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    now = _digest(edges)
    for _ in range(max_rounds):
        # large star: every larger neighbour is linked to the node's smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the node and its smaller neighbours are linked to the smallest of them
        down = large.where("u != v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        following = materialise(small.where("u != v").distinct(), "edges")
        edges, before, now = following, now, _digest(following)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("class"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(roots)


def near_classes(df: DataFrame, rec_id: str, block: str, seq: str) -> DataFrame:
    """One row per record: id, class (the smallest id of its group), links (near other texts of its own) and copies (ids with its very text)."""
    members, links = near_pairs(df, rec_id, block, seq)
    rows = df.select(F.col(rec_id).cast("long").alias("id")).dropna().distinct()
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    classes = components(links).select(F.col("node").alias("rep"), "class")
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    located = rows.join(members.groupBy("id").agg(F.min("rep").alias("rep")), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    met = located.join(classes, "rep", "left").join(degree, "rep", "left").join(copies, "rep", "left")
    return met.select("id", F.coalesce("class", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"))
