"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never runs merges. An Aho-Corasick automaton gives the longest token at every position
of a word; the encoder takes it if the pair with the token before it is one that BPE would leave
apart, else tries the next shorter token, else steps back. A bit per position marks where no way
leads on, so every position is left for good at most once per token that ends there and the work is
linear. Two tokens may stand side by side exactly if undoing their last merges never meets a merge
that would have come first across the border; token ids follow merge order, which makes that a walk
down both tokens' split tables.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; an empty
table gives an empty result; further columns are not read. Memory is that of one block of rows
(``row_blocks``), the tables and a bounded cache of words.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnlens.llm.tables import held, row_blocks, trim
from txnlens.llm.vocab import CLASSES, SPACE, WordIds, byte_symbols, gathered, is_exotic

# Of text or ids in one block, which takes some thirty times its size while its words are cut and gathered.
BLOCK_BYTES = 1 << 19

# Fixed value: the word pattern of the tokenizer files that are supported.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PairTable:
    """Which token pairs BPE leaves side by side."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        self.made = {(a, b): made for a, b, made in merges}
        self.left, self.right = list(range(size)), list(range(size))
        for a, b, made in merges:
            self.left[made], self.right[made] = a, b

    def fits(self, a: int, b: int) -> bool:
        """Undo the later of both tokens' merges, step by step, down to single symbols.

        At each step the border pair must not have a merge that comes before the merge undone last.
        """
        limit = len(self.left) + 1
        while True:
            made = self.made.get((a, b))
            if made is not None and made < limit:
                return False
            # of both merges the later one is undone; on equal ids the right one was made later
            if a > b and self.right[a] != a:
                limit, a = a, self.right[a]
            elif b >= a and self.left[b] != b:
                limit, b = b + 1, self.left[b]
            elif self.right[a] != a:
                limit, a = a, self.right[a]
            elif self.left[b] != b:
                limit, b = b + 1, self.left[b]
            else:
                return True


class BpeEncoder:
    """Encoder and decoder of one tokenizer file (BPE with byte symbols and a word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        symbol = {c: chr(b) for b, c in enumerate(byte_symbols())}

        def symbols(token: str) -> str:
            """The token with one character per symbol; those that end a word are 256 higher."""
            body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            out = "".join(symbol[c] for c in body)
            return out if body == token else out[:-1] + chr(ord(out[-1]) + 256)

        splitter = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if splitter != WORDS:
            raise ValueError("the words of this tokenizer are cut by another pattern")
        vocab: dict[str, int] = model["vocab"]
        self.ends = bool(suffix)
        self.tokens = {symbols(t): i for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a[: len(a)] + b]) for a, b in pairs]
        if any(x[2] >= y[2] for x, y in zip(merges, merges[1:])):
            raise ValueError("token ids have to follow the order of the merges")
        self.pairs = PairTable(merges, size)
        self.length = [0] * size
        self.shorter: list[int] = [-1] * size  # the longest token that starts this one
        self.automaton = ahocorasick.Automaton()
        for token, i in self.tokens.items():
            self.length[i] = len(token)
            self.automaton.add_word(token, i)
            self.shorter[i] = next(
                (self.tokens[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.tokens),
                -1,
            )
        self.automaton.make_automaton()

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space are not supported")
        marks = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(marks)})") if marks else None
        # the library only normalizes and cuts: its own vocabulary and merges aren't loaded
        bare = {**spec, "added_tokens": [], "post_processor": None, "model": {**model, "vocab": {}, "merges": []}}
        bare["model"]["unk_token"] = None
        self.library = Tokenizer.from_str(json.dumps(bare))
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.words = WordIds(self.word_ids, space_leads=False)

        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.piece_sizes = np.array([len(p) for p in pieces], np.int32)
        self.piece_starts = np.concatenate([[0], np.cumsum(self.piece_sizes)[:-1]]).astype(np.int32)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one word, exactly those that the merges would give; none for white space."""
        raw = word.decode("latin-1")
        if is_space(word):
            return []
        if self.ends:
            raw = raw[:-1] + chr(ord(raw[-1]) + 256)
        n, length = len(raw), self.length
        longest = [0] * n
        for end, token in self.automaton.iter(raw):  # later matches of a start are longer
            longest[end - length[token] + 1] = token
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if open_at[end] and (not out or self.pairs.fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]

    def exotic_ids(self, text: str) -> bytes:
        """Ids of a text with any characters: the library normalizes it and cuts its words."""
        normal = self.library.normalizer.normalize_str(text)
        cut = self.library.pre_tokenizer.pre_tokenize_str(normal)
        words = (bytes(self.byte_of[c] for c in piece) for piece, _ in cut)
        return b"".join(map(self.words.of_word, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as little-endian 32-bit integers.

        Added tokens are ids of their own wherever their strings stand, so texts are cut there.
        """
        pieces: list[tuple[int, str]] = []  # (row, text without added tokens)
        for row, text in enumerate(texts):
            cut = [text] if self.marks is None else self.marks.split(text)
            pieces += [(row, part) for part in cut if part]
        plain: dict[int, bytes] = {}
        for k, (_, part) in enumerate(pieces):
            # white space only separates words and such texts are composed already, so lower case will do
            if part not in self.special and not is_exotic(part) and not is_exotic(lower := part.lower()):
                plain[k] = lower.encode()
        ids = dict(zip(plain, self.words.of_texts([*plain.values()])))
        out: list[list[bytes]] = [[] for _ in texts]
        for k, (row, part) in enumerate(pieces):
            if part in self.special:
                out[row].append(struct.pack("<I", self.special[part]))
            else:
                out[row].append(ids[k] if k in ids else self.exotic_ids(part))
        return [b"".join(x) for x in out]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The text of each row of ids: its tokens with a space between, by gathers."""
        ids = np.frombuffer(b"".join(rows), "<u4")
        sizes = self.piece_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        text = b"".join(gathered(self.piece_bytes, self.piece_starts[ids], sizes))
        cuts = ends[np.cumsum([0, *(len(r) // 4 for r in rows)])].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


def is_space(word: bytes) -> bool:
    char = word[:2].decode(errors="ignore")[:1]
    return char != "" and ord(char) < len(CLASSES) and CLASSES[ord(char)] == SPACE


def encoder(path: str) -> BpeEncoder:
    """One encoder per worker process and file."""

    def load() -> BpeEncoder:
        model = BpeEncoder(path)
        trim()  # of the parsed file
        return model

    return held((BpeEncoder.__name__, path), load)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the ids of every text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for block in row_blocks(batches, most=BLOCK_BYTES):
            ids = model.encode(block.column("text").to_pylist())
            yield pa.record_batch([block.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(
        run, "doc_id bigint, ids binary"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the decoded text of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for block in row_blocks(batches, "ids", BLOCK_BYTES):
            texts = model.decode(block.column("ids").to_pylist())
            yield pa.record_batch(
                [block.column("doc_id"), block.column("ids"), pa.array(texts, pa.binary())],
                ["doc_id", "ids", "text"],
            )

    return encoded.mapInArrow(run, "doc_id bigint, ids binary, text binary").withColumn(
        "text", F.col("text").cast("string")
    )


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them; both directions in one pass and one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for block in row_blocks(batches, most=BLOCK_BYTES):
            ids = model.encode(block.column("text").to_pylist())
            yield pa.record_batch(
                [block.column("doc_id"), pa.array(ids, pa.binary()), pa.array(model.decode(ids), pa.binary())],
                ["doc_id", "ids", "text"],
            )

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    return rows.mapInArrow(run, "doc_id bigint, ids binary, text binary").withColumn(
        "text", F.col("text").cast("string")
    )


def with_digests(decoded: DataFrame) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256."""
    return decoded.withColumns(
        {
            "n_tokens": (F.length("ids") / 4).cast("bigint"),
            "ids_sha256": F.sha2("ids", 256),
            "decoded_sha256": F.sha2(F.col("text").cast("binary"), 256),
        }
    )
