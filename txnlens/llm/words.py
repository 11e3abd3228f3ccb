"""Words of many texts at once, as codes into a block's dictionary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# Words are runs of 0-9, A-Z (lower-cased), a-z and all bytes outside ASCII.
_TO_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0
    for b in range(256)
)


def word_codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, words per text, 64-bit hash of each different word); null has no words."""
    joined = b"\0".join([*(t or b"" for t in texts), b""])
    data = np.frombuffer(b"\0" + joined.translate(_TO_WORD), np.uint8)
    inside = data != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]  # a text always ends with a separator
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    kept = data[inside]
    words = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
    ).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int32) if len(starts) else np.zeros(0, np.int32)
    text_ends = np.cumsum([len(t or b"") + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in words.dictionary.to_pylist()], np.uint64)
    return codes, counts, hashes
