"""Phrase collocation mining on a weighted de Bruijn graph of words.

Texts are cut into pieces and those into words. The longest grams that are counted, three words, are edges
of a graph whose nodes are the pairs of words in which two edges overlap. Every word of a piece starts one
edge; where a piece ends, the words missing are its end mark. So the edges alone hold all counts: a pair occurs
as often as weight flows out of its node, marks included, and a word as often as its pairs and its mark.

Tasks add up the edges of a block of texts and send them by their first word, with the outgoing edges in
one row. Words and pairs that hold more than half a task's share in a sample are dealt by two or three
words instead, and their partial sums are added afterwards. A task therefore sees all edges of its words and
keeps only words, pairs and edges that are frequent enough. Of that graph unary paths are compacted: where
all that flows into a node comes by one edge and leaves by one edge, both edges belong to the same path. The
paths, the words and the nodes between paths are the phrase table; counts of phrases are read off it.

Words travel as 63-bit hashes of language and word. For each word of a phrase all words of that hash
are looked up; if there are two, everything is counted again with other hashes, so counts are exact.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count each; an
empty table gives no phrases; further columns are not read. Products are decimals of 38 digits, enough for
counts up to 10**15. One text must fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.tables import default_parts, release, row_blocks, stage

# The marks that end a piece, and white space between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

UNKNOWN = "und"
BLOCK_BYTES = 4 << 20
TASK_BYTES = 8 << 20  # of text whose edges one task adds up
MERGE_EDGES = 2_000_000  # edges that a task gathers before it adds them up
# The sample in which hot words are found; it decides only where rows go.
SAMPLE_SHARE, SAMPLE_ROWS = 0.01, 2_000
MOST_HOT = 100_000
# Words and languages of phrases are sent to all tasks up to this many; beyond, they are joined by shuffle.
BROADCAST_WORDS = 500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256)], np.uint8)
EDGE = np.dtype([("y", "<i8"), ("z", "<i8"), ("n", "<u4")])


class Words(NamedTuple):
    """The words of a block: number of (language, word) and piece of each place; the different ones."""

    code: np.ndarray
    piece: np.ndarray
    different: list[tuple[str, bytes]]


def words_of(block: pa.RecordBatch) -> Words:
    texts = [t or b"" for t in block.column("text").to_pylist()]
    joined = b"\n".join([b"", *texts, b""]).translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    found = found.dictionary_encode()
    word = found.indices.to_numpy().astype(np.int64)
    names = found.dictionary.to_pylist()
    langs = block.column("lang").dictionary_encode()
    text_starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    lang = langs.indices.to_numpy().astype(np.int64)[np.searchsorted(text_starts, starts, "right") - 1]
    both, code = np.unique(lang * max(1, len(names)) + word, return_inverse=True)
    of_lang = langs.dictionary.to_pylist()
    different = [(of_lang[k // len(names)], names[k % len(names)]) for k in both.tolist()]
    return Words(code, np.cumsum(kind == 2, dtype=np.int32)[starts], different)


def names_of(words: Words, seed: int) -> np.ndarray:
    """Hashes of the different words from 1 up; 0 is the end mark."""
    digest = xxhash.xxh3_64_intdigest
    seeds = {lang: digest(lang.encode(), seed) for lang in {lang for lang, _ in words.different}}
    hashes = np.array([digest(word, seeds[lang]) for lang, word in words.different], np.uint64)
    return np.maximum(hashes >> np.uint64(1), np.uint64(1)).astype(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.int64(-7046029254386353131) + (b ^ (b >> 32)) * np.int64(-2960836687051489587)
        return x ^ (x >> 29)


def added(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Equal edges as one, sorted."""
    order = np.lexsort((z, y, x))
    x, y, z, n = x[order], y[order], z[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]))
    return [x[first], y[first], z[first], np.add.reduceat(n, first)] if len(x) else [x, y, z, n]


def block_edges(words: Words, seed: int) -> list[np.ndarray]:
    """(x, y, z, n): the edges of a block by the hashes of their words, with 0 for the end mark."""
    code, piece = words.code, words.piece
    following = np.zeros((2, len(code)), np.int64)
    for k in (1, 2):
        same = np.flatnonzero(piece[k:] == piece[:-k])
        following[k - 1, same] = code[same + k] + 1
    y, z = following
    base = len(words.different) + 1
    names = np.concatenate([[0], names_of(words, seed)])
    if base < 1 << 21:
        keys, n = np.unique((code * base + y) * base + z, return_counts=True)
        return [names[keys // base // base + 1], names[keys // base % base], names[keys % base], n]
    return added(names[code + 1], names[y], names[z], np.ones(len(code), np.int64))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))


def hot_words(docs: DataFrame, seed: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and pairs as one hash, that hold more than half a task's share of a sample's words."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in row_blocks(batches, most=BLOCK_BYTES):
            x, y, _, n = block_edges(words_of(block), seed)
            pair, at = np.unique(mixed(x, y), return_inverse=True)
            word, of = np.unique(x, return_inverse=True)
            columns = [
                np.concatenate([word, pair]),
                np.concatenate([np.bincount(of, n, len(word)), np.bincount(at, n, len(pair))]).astype(np.int64),
                np.repeat([1, 2], [len(word), len(pair)]).astype(np.int32),
            ]
            yield pa.record_batch([pa.array(c) for c in columns], ["name", "n", "size"])

    seen = texts_of(docs).sample(share, seed=7).mapInArrow(run, "name bigint, n bigint, size int")
    sums = stage(seen.groupBy("size", "name").agg(F.sum("n").alias("n")), "sampled_words")
    total = sums.where("size = 1").agg(F.sum("n")).first()[0] or 0
    hot = [sums.where((F.col("size") == k) & (F.col("n") > total / (2 * parts))) for k in (1, 2)]
    return tuple(np.array([r["name"] for r in h.orderBy(F.desc("n"), "name").limit(MOST_HOT).collect()], np.int64) for h in hot)


def edge_rows(docs: DataFrame, seed: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, x, edges): a word's outgoing edges in a block, and the key by which they are dealt."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        release()
        for block in row_blocks(batches, most=BLOCK_BYTES):
            x, y, z, n = block_edges(words_of(block), seed)
            if not len(x):
                continue
            pair = mixed(x, y)
            crowded = np.isin(x, words)
            key = np.where(crowded, np.where(np.isin(pair, pairs), mixed(pair, z), pair), x)
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (key[1:] != key[:-1])]))
            out = np.empty(len(x), EDGE)
            out["y"], out["z"], out["n"] = y, z, n
            offsets = (np.append(first, len(x)) * EDGE.itemsize).astype(np.int32)
            edges = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
            yield pa.record_batch([pa.array(key[first]), pa.array(x[first]), edges], ["key", "x", "edges"])

    return texts_of(docs).mapInArrow(run, "key bigint, x bigint, edges binary")


def frequent(docs: DataFrame, seed: int, least: int) -> DataFrame:
    """(size, x, y, z, n): words, pairs and edges that occur ``least`` times or more; written."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(default_parts(spark), -(-size // TASK_BYTES))
    hot = hot_words(docs, seed, parts)
    sent = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        held, total, held_edges = [], [np.zeros(0, np.int64)] * 4, 0
        for batch in batches:
            raw = batch.column("edges").to_pylist()
            edges = np.frombuffer(b"".join(raw), EDGE)
            x = np.repeat(batch.column("x").to_numpy(), [len(r) // EDGE.itemsize for r in raw])
            held.append([x, edges["y"].copy(), edges["z"].copy(), edges["n"].astype(np.int64)])
            held_edges += len(x)
            if held_edges > MERGE_EDGES:
                total, held, held_edges = added(*map(np.concatenate, zip(total, *held))), [], 0
        x, y, z, n = added(*map(np.concatenate, zip(total, *held)))
        if not len(x):
            return
        of_word = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        of_pair = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        word_n, flow = np.add.reduceat(n, of_word), np.add.reduceat(n, of_pair)
        zeros = np.zeros_like
        # sums of words and pairs that are dealt to many tasks are partial: all of them stay
        rows = [
            (1, x[of_word], zeros(of_word), zeros(of_word), word_n, (word_n >= least) | np.isin(x[of_word], words)),
            (2, x[of_pair], y[of_pair], zeros(of_pair), flow,
             ((flow >= least) | np.isin(mixed(x[of_pair], y[of_pair]), pairs)) & (y[of_pair] != 0)),
            (3, x, y, z, n, (n >= least) & (z != 0)),
        ]
        for size, a, b, c, total, kept in rows:
            columns = [np.full(kept.sum(), size, np.int32), a[kept], b[kept], c[kept], total[kept]]
            yield pa.record_batch([pa.array(v) for v in columns], ["size", "x", "y", "z", "n"])

    dealt = edge_rows(docs, seed, hot).repartition(parts, "key")
    sums = stage(dealt.mapInArrow(run, "size int, x bigint, y bigint, z bigint, n bigint"), "grams")
    total = sums.groupBy("size", "x", "y", "z").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stage(total, "frequent_grams")


def compact(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, n) of the unary paths, and (x, y, n) of the nodes that aren't inside a path.

    Each edge points to the one before it if their common node is unary, and pointers are doubled until
    they reach the first edge of the path. Rings have no first edge; their edges stay single.
    """
    nodes = grams.where("size = 2").select("x", "y", "n")
    edges = stage(grams.where("size = 3").select(F.monotonically_increasing_id().alias("id"), "x", "y", "z", "n"), "edges")
    into = edges.groupBy(F.col("y").alias("x"), F.col("z").alias("y")).agg(
        F.count(F.lit(1)).alias("n_in"), F.max("n").alias("in"), F.max("id").alias("before")
    )
    out = edges.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_out"), F.max("n").alias("out"))
    single = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("in") == F.col("n")) & (F.col("out") == F.col("n"))
    marked = nodes.join(into, ["x", "y"], "left").join(out, ["x", "y"], "left")
    marked = stage(marked.select("x", "y", "n", "before", F.coalesce(single, F.lit(False)).alias("unary")), "nodes")
    inner = marked.where("unary").select("x", "y", "before")
    steps = edges.join(inner, ["x", "y"], "left").select("id", F.coalesce("before", "id").alias("first"))
    steps = stage(steps.select("id", "first", F.when(F.col("first") == F.col("id"), 0).otherwise(1).cast("bigint").alias("far")), "steps")
    waiting = None
    while True:
        ahead = steps.select(F.col("id").alias("first"), F.col("first").alias("next"), F.col("far").alias("on"))
        joined = steps.join(ahead, "first").select(
            "id", F.col("next").alias("first"), (F.col("far") + F.col("on")).alias("far"), (F.col("on") > 0).alias("moved")
        )
        steps = stage(joined, "steps")
        moved = steps.where("moved").count()
        if not moved or moved == waiting:
            break
        waiting = moved
    # an edge that still moves is on a ring
    place = steps.select("id", F.when(F.col("moved"), F.col("id")).otherwise(F.col("first")).alias("path"),
                         F.when(F.col("moved"), 0).otherwise(F.col("far")).alias("far"))
    rows = edges.join(place, "id").groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("far", "x", "y", "z"))).alias("steps"), F.max("n").alias("n")
    )
    first = F.col("steps")[0]
    names = F.concat(F.array(first["x"], first["y"]), F.transform("steps", lambda s: s["z"]))
    return stage(rows.select(names.alias("names"), "n"), "paths"), marked.where("NOT unary").select("x", "y", "n")


def triples(paths: DataFrame) -> DataFrame:
    """(x, y, z, n) along all paths."""
    places = F.sequence(F.lit(0), F.size("names") - 3)
    at = lambda i: F.struct(F.get("names", i).alias("x"), F.get("names", i + 1).alias("y"), F.get("names", i + 2).alias("z"))
    return paths.select(F.explode(F.transform(places, at)).alias("g"), "n").select("g.*", "n")


def pairs(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, y, n): inside a path a pair occurs as often as the path, elsewhere as much as flows out of its node."""
    inside = F.sequence(F.lit(1), F.size("names") - 3)
    at = lambda i: F.struct(F.get("names", i).alias("x"), F.get("names", i + 1).alias("y"))
    long = paths.where(F.size("names") > 3).select(F.explode(F.transform(inside, at)).alias("g"), "n").select("g.*", "n")
    return nodes.unionByName(long)


def vocabulary(docs: DataFrame, needed: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(name, lang, word) of all words whose name is needed, and (lang, n) of all words; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in row_blocks(batches, most=BLOCK_BYTES):
            words = words_of(block)
            counts = np.bincount(words.code, minlength=len(words.different))
            langs, words_ = zip(*words.different) if words.different else ((), ())
            yield pa.record_batch(
                [pa.array(names_of(words, seed)), pa.array(langs, pa.string()), pa.array([w.decode() for w in words_], pa.string()), pa.array(counts)],
                ["name", "lang", "word", "n"],
            )

    found = texts_of(docs).mapInArrow(run, "name bigint, lang string, word string, n bigint")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_WORDS else needed
    # one pass: a word that isn't needed only counts for its language
    kept = found.join(needed.withColumn("used", F.lit(True)), "name", "left").select(
        "lang", "n", F.when(F.col("used"), F.col("name")).alias("name"), F.when(F.col("used"), F.col("word")).alias("word")
    )
    words = stage(kept.groupBy("lang", "name", "word").agg(F.sum("n").alias("n")), "vocabulary")
    return words.where("name IS NOT NULL").select("name", "lang", "word"), words.groupBy("lang").agg(F.sum("n").alias("n"))


class PhraseTable(NamedTuple):
    paths: DataFrame  # names, n
    nodes: DataFrame  # x, y, n: the pairs that aren't inside a path
    words: DataFrame  # name, lang, word, n
    totals: DataFrame  # lang, n


def phrase_table(docs: DataFrame, least: int) -> PhraseTable:
    """The compacted graph of all phrases that occur ``least`` times or more."""
    for seed in count():
        grams = frequent(docs, seed, least)
        paths, nodes = compact(grams)
        # a pair's words are frequent, and so are those of a triple, which has two pairs
        in_pairs = grams.where("size = 2").select(F.explode(F.array("x", "y")).alias("name")).distinct()
        words, totals = vocabulary(docs, stage(in_pairs, "names"), seed)
        if not words.groupBy("name").count().where("count > 1").limit(1).count():
            singles = grams.where("size = 1").select(F.col("x").alias("name"), "n")
            return PhraseTable(paths, nodes, stage(words.join(singles, "name"), "words"), totals)


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(table: PhraseTable, top: int, covered: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by their lowest cut.

    A pair goes if a triple holding it occurs ``covered`` hundredths as often or more.
    """
    three, two = triples(table.paths), stage(pairs(table.paths, table.nodes), "pairs")
    one = table.words.select("name", "n", "word")
    word = lambda at: one.select(F.col("name").alias(at), F.col("n").alias(f"n_{at}"), F.col("word").alias(f"w_{at}"))
    longer = three.select("x", "y", "n").unionByName(three.select(F.col("y").alias("x"), F.col("z").alias("y"), "n"))
    longer = longer.groupBy("x", "y").agg(F.max("n").alias("longer"))
    kept = two.join(longer, ["x", "y"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("n"), F.lit(True)))
    short = (
        kept.join(word("x"), "x").join(word("y"), "y")
        .select("x", F.concat_ws(" ", "w_x", "w_y").alias("phrase"), F.col("n").alias("a"),
                F.col("n_x").alias("l"), F.col("n_y").alias("r"), cut_score(F.col("n"), F.col("n_x"), F.col("n_y")).alias("score"))
    )
    ahead = two.select("x", "y", F.col("n").alias("n_xy"))
    behind = two.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("n_yz"))
    cuts = [
        F.struct(cut_score(F.col("n"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
        for k, (left, right) in enumerate([("n_x", "n_yz"), ("n_xy", "n_z")], 1)
    ]
    long = (
        three.join(ahead, ["x", "y"]).join(behind, ["y", "z"])
        .join(word("x"), "x").join(word("y"), "y").join(word("z"), "z")
        .select("x", F.concat_ws(" ", "w_x", "w_y", "w_z").alias("phrase"), F.col("n").alias("a"), F.least(*cuts).alias("cut"))
        .select("x", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    langs = table.words.select(F.col("name").alias("x"), "lang")
    found = short.unionByName(long).join(langs, "x")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(table.totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def mine(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50) -> DataFrame:
    return collocations(phrase_table(docs, least), top, covered)
