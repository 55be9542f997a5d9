"""Columnar word splitting shared by the text operators: no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: a word divided at a line end
_DIVIDED = r"-[ \t]*\r?\n[ \t]*"
#: characters of no width
_UNSEEN = r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]+"
_BETWEEN = r"[^\p{L}\p{N}]+"


def split_words(texts: pa.Array, between: str = _BETWEEN) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, lower case, in one dictionary-encoded array, and each text's first word (and the end).

    Words divided at a line end are joined. A null text has no words.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pc.replace_substring_regex(low, pattern=_DIVIDED, replacement="")
    low = pc.replace_substring_regex(low, pattern=_UNSEEN, replacement="")
    low = pc.utf8_trim_whitespace(pc.replace_substring_regex(low, pattern=between, replacement=" "))
    lists = pc.split_pattern(low, pattern=" ")
    words = lists.flatten()
    ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
    return words.dictionary_encode(), np.concatenate(([0], ends))


def word_hashes(dictionary: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash per word; the empty word is 0."""
    return np.array([xxhash.xxh64_intdigest(w, seed) if w else 0 for w in dictionary.to_pylist()], np.uint64)


def small_slices(batch: pa.RecordBatch, column: str | int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of at most ``most`` bytes of text (a longer text stands alone): bounds a kernel's memory, not its work."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        until = max(until, at + 1)
        yield batch.slice(at, until - at)
        at = until
