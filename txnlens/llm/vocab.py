"""Public tokenizer files: byte symbols, and the words of many texts at once.

Both word patterns here cut a text where the class of its characters changes (letter, number,
other, white space), so a block of texts is cut with a few array operations on its bytes. Each
different word of the block is then encoded once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# From this code point on, texts take the library's own normalizer and word splitter, whose Unicode
# tables may differ from Python's; below it both agree.
EXOTIC = 0x250

LETTER, NUMBER, OTHER, SPACE = range(4)

# Runs that are gathered at once.
GATHERED = 1 << 16

# White space below EXOTIC, and the contractions that both patterns cut off.
SPACES = {*range(9, 14), 32, 0x85, 0xA0}
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies use for each byte.

    Printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def is_exotic(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ord(max(text)) >= EXOTIC
    return False


def _class_of(code: int) -> int:
    kind = unicodedata.category(chr(code))[0]
    return SPACE if code in SPACES else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)


CLASSES = np.array([_class_of(c) for c in range(EXOTIC)], np.uint8)


def word_starts(data: np.ndarray, texts: np.ndarray, space_leads: bool) -> np.ndarray:
    """Where words start in the UTF-8 bytes of texts put end to end (code points below EXOTIC).

    ``texts`` has where each text starts. White space is cut off too. With ``space_leads`` one blank
    belongs to the word after it, runs of numbers are one word, and of other white space the last
    character is cut off from the run before a word; without, each number is a word.
    """
    n = len(data)
    kind = CLASSES[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    code = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
    kind[lead] = CLASSES[code]
    kind[lead + 1] = kind[lead]
    first = np.ones(n, bool)  # first byte of a character
    first[lead + 1] = False

    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts[texts] = True
    if space_leads:
        # the last white-space character before a word; a blank takes the word's start
        ends = np.flatnonzero(starts[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
        ends = ends[~np.isin(ends, texts, assume_unique=True)]
        last = ends - 1
        last = np.where(first[last], last, last - 1)
        starts[last] = True
        starts[ends[data[last] == 32]] = False
    else:
        starts |= (kind == NUMBER) & first

    quotes = np.flatnonzero((data == 39) & starts)
    if len(quotes):
        stop = np.append(texts[1:], n)[np.searchsorted(texts, quotes, "right") - 1]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        for tail in CONTRACTIONS:
            fits = quotes + 1 + len(tail) <= stop
            for k, byte in enumerate(tail):
                fits &= padded[quotes + 1 + k] == byte
            cut = quotes[fits]
            starts[cut + 1] = False
            after = cut + 1 + len(tail)
            starts[after[after < stop[fits]]] = True
    return np.flatnonzero(starts)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
    """Runs of ``values`` put end to end, by one gather for every ``GATHERED`` runs.

    A gather takes two wide numbers for each value, many times what it gives.
    """
    for k in range(0, len(starts), GATHERED):
        some = sizes[k : k + GATHERED]
        ends = np.cumsum(some, dtype=np.int64)
        source = np.repeat(starts[k : k + GATHERED] - (ends - some), some)
        source += np.arange(len(source))
        yield values[source].tobytes()


class WordIds:
    """Ids of whole texts from an encoder of single words; the words seen are kept, up to a bound."""

    def __init__(
        self, encode: Callable[[bytes], list[int]], space_leads: bool, most: int = 300_000
    ):
        self.encode, self.space_leads, self.most = encode, space_leads, most
        self.seen: dict[bytes, bytes] = {}

    def of_word(self, word: bytes) -> bytes:
        ids = self.seen.get(word)
        if ids is None:
            ids = np.array(self.encode(word), "<u4").tobytes()
            if len(self.seen) >= self.most:
                self.seen.clear()
            if len(word) <= 64:
                self.seen[word] = ids
        return ids

    def of_texts(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; code points below EXOTIC only."""
        sizes = np.array([len(t) for t in texts], np.int64)
        full = np.flatnonzero(sizes)
        out = [b""] * len(texts)
        if not len(full):
            return out
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes[full])])
        starts = word_starts(data, bounds[:-1], self.space_leads)
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]
        ).dictionary_encode()
        code = words.indices.to_numpy()
        per_word = [self.of_word(w) for w in words.dictionary.to_pylist()]
        counts = np.array([len(x) // 4 for x in per_word], np.int64)
        flat = np.frombuffer(b"".join(per_word), "<u4")
        place = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sizes = counts[code]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = b"".join(gathered(flat, place[code], sizes))
        cuts = (ends[np.searchsorted(starts, bounds)] * 4).tolist()
        for i, a, b in zip(full.tolist(), cuts, cuts[1:]):
            out[i] = raw[a:b]
        return out
