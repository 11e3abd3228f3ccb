"""Language ID by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed against
each automaton into longest matches: a phrase ends where no longer substring of the sample goes on.
The language with the fewest phrases, weighted by the bits that point to a phrase (the logarithm of
the sample's length), wins. Letters are lower-cased and every run of other characters is one blank.

Texts of a block are parsed side by side, one character of every text and language per step, so
they are cut into segments of ``SEGMENT`` characters at which a new phrase starts.

Defined results: a null text or one without a letter, or any text if there is nothing to learn from,
is ``und`` with score 0; equal entropies go to the first language by name; repeated rows are judged
each; a null doc_id counts as an empty text in the split; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.llm.tables import columns_of, release, row_blocks

# The learning sample: the start of one document from each of SAMPLE_SLOTS hash slots per language.
SAMPLE_SLOTS = 64
SLOT_CHARS = 1_000
MOST_LANGUAGES = 500
DENSE_CELLS = 1 << 24  # of the table for the most common letters; the others are found by binary search
SEGMENT = 1024
BLOCK_BYTES = 3 << 20  # of text in one block
UNKNOWN = "und"


def held_out() -> F.Column:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    return remainder == 1


def learn(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, sample text): at most SAMPLE_SLOTS x SLOT_CHARS characters each.

    Of each slot the document with the smallest hash is taken, which is found before the shuffle.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    picked = (
        known.select("lang", F.substring("text", 1, SLOT_CHARS).alias("text"), order.alias("h"))
        .groupBy("lang", F.pmod("h", F.lit(SAMPLE_SLOTS)).alias("slot"))
        .agg(F.min_by("text", "h").alias("text"))
    )
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in picked.toLocalIterator():
        texts.setdefault(row["lang"], []).append((row["slot"], row["text"]))
        if len(texts) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return [(lang, "\n".join(t for _, t in sorted(texts[lang]))) for lang in sorted(texts)]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def normal(text: str) -> np.ndarray:
    """Code points of the text: letters, and one blank for each run of others."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters()[codes], codes, 32)
    return codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))] if len(codes) else codes


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return step


class Model:
    """The automata of all languages in one table.

    ``table[state + code]`` is twice the next state, plus one if a phrase ended before the
    character. States are multiples of ``width``, the number of codes that have a column. Transitions by
    other codes are in ``values``, by row and code in ``keys``, which are sorted.
    """

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = [lang for lang, _ in samples]
        texts = [normal(text) for _, text in samples]
        seen, counts = np.unique(np.concatenate([np.zeros(0, "<u4"), *texts]), return_counts=True)
        self.code = np.zeros(0x110000, np.uint32)
        self.code[seen[np.argsort(-counts, kind="stable")]] = np.arange(1, len(seen) + 1)
        states = sum(2 * len(text) + 2 for text in texts)  # at most
        self.width = width = 1 + min(len(seen), max(0, DENSE_CELLS // max(1, states) - 1))
        tables, keys, values, self.starts, base = [], [], [], [], 0
        for text in texts:
            step = suffix_automaton(self.code[text].tolist())
            if base + (len(step) + 1) * width >= 2**30:
                raise ValueError("the languages' samples are too large together")
            # the last row is where a parse starts and where a letter outside the sample leads: no
            # phrase goes on from there
            rows = np.repeat(np.arange(len(step)), [len(s) for s in step])
            cols = np.array([c for s in step for c in s], np.int64)
            to = np.array([q for s in step for q in s.values()], np.int64)
            first = rows == 0
            fresh = np.full(width, len(step), np.int32)
            dense = cols < width
            fresh[cols[first & dense]] = to[first & dense]
            table = np.tile((fresh * width + base) * 2 + 1, (len(step) + 1, 1))
            table[rows[dense], cols[dense]] = (to[dense] * width + base) * 2
            begin = first & ~dense
            rows = np.concatenate([rows[~dense], np.full(begin.sum(), len(step))]) + base // width
            keys.append(rows << 21 | np.concatenate([cols[~dense], cols[begin]]))
            values.append((np.concatenate([to[~dense], to[begin]]) * width + base) * 2 + (rows == len(step) + base // width))
            tables.append(table.ravel())
            self.starts.append(base + len(step) * width)
            base += table.size
        self.table = np.concatenate([np.zeros(0, np.int32), *tables])
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], np.concatenate([np.zeros(0, np.int64), *values])[order].astype(np.int32)
        self.bits = np.log2(np.array([max(2, len(t)) for t in texts]))

    def rare(self, state: np.ndarray, codes: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Where codes without a column lead: on, else to a new phrase, else to ``to``."""
        for rows in (np.broadcast_to(np.array(self.starts)[:, None], state.shape), state):
            key = rows.astype(np.int64) // self.width << 21 | codes
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to = np.where(self.keys[at] == key, self.values[at], to)
        return to

    def phrases(self, segments: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Phrases of each segment (start, size; the longest first) in each language."""
        state = np.repeat(np.array(self.starts, np.int32)[:, None], len(segments), axis=1)
        count = np.zeros((len(self.starts), len(segments)), np.int32)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # segments longer than t
            now = codes[segments[:live] + t]
            out = now >= self.width
            to = self.table[state[:, :live] + np.where(out, 0, now).astype(np.int32)]
            if out.any():
                to[:, out] = self.rare(state[:, :live][:, out], now[out], to[:, out])
            count[:, :live] += to & 1
            state[:, :live] = to >> 1
        return count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        points = [normal(t or "") for t in texts]
        found = [bool((p != 32).any()) for p in points]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        codes = self.code[np.concatenate([np.zeros(0, "<u4"), *points])]
        lengths = np.array([len(p) for p in points])
        pieces = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(len(texts)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(lengths) - lengths, pieces) + piece * SEGMENT
        size = np.minimum(SEGMENT, lengths[row] - piece * SEGMENT)
        order = np.argsort(-size, kind="stable")
        count = self.phrases(start[order], size[order], codes)
        bits = np.zeros((len(texts), len(self.languages)))
        np.add.at(bits, row[order], count.T)
        bits *= self.bits
        out = []
        for ok, b, n in zip(found, bits, lengths):
            if not ok:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(b.argmin())
            other = np.delete(b, best).min() if len(b) > 1 else max(b[best], n * self.bits[best])
            out.append((self.languages[best], float(1 - b[best] / other)))
        return out


def predict(docs: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """Every row as a struct ``row``, with lang_pred and score; only the text is looked at."""
    # built once: a table of at most DENSE_CELLS cells and the samples' rare letters
    sent = docs.sparkSession.sparkContext.broadcast(Model(samples))
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = sent.value
        both = (pa.record_batch([b.column(0), b.column(0).field("text")], ["row", "text"]) for b in batches)
        for block in row_blocks(both, most=BLOCK_BYTES):
            found = model.predict(block.column("text").to_pylist())
            yield pa.record_batch(
                [block.column("row"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found])],
                ["row", "lang_pred", "score"],
            )

    schema = T.StructType(
        [rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return rows.mapInArrow(run, schema)
