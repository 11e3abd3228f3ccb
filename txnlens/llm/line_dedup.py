"""Line dedup by a segment-partition edit join.

Lines are compared in lower case with white space collapsed. Equal lines are duplicates; so are lines
of ``MIN_CHARS`` or more characters within ``EDITS`` edits of each other, and lines such links join up.
Of each class the first line by (doc_id, row, line number) stays.

A line is split into ``EDITS + 1`` segments; a line within that many edits has one of them unchanged,
at a place that depends on both lengths. So each line puts its segments into an index, under keys made of
line length, segment number and segment, and probes it with the few substrings that could be a segment of
a line as long or up to ``EDITS`` shorter. Every block of documents sends its keys, without repeats, to
hash buckets; a bucket matches probes with segments. A key that very many lines share is cut into
tiles that are matched in tasks of their own. A line's id holds the parity of its characters' counts in 32
classes, and since an edit changes two of these at most, most chance matches end there. The rest are
verified by a banded bit-parallel edit distance.

Defined results: blank lines and null texts are left alone; rows with the same doc_id and the same text
count as one document, rows with the same doc_id and other texts as documents of their own, by the hash of
their text; every row without doc_id is a document of its own and these come first, in the order of the
table as it was staged; an empty table gives an empty result. A line and the keys of one block have to fit
into memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.components import connected_components
from txnlens.llm.tables import columns_of, default_parts, release, row_blocks, stage

EDITS = 2
MIN_CHARS = 20
BUCKET_BYTES = 16 << 20  # of text, whose keys one bucket holds
BLOCK_BYTES = 2 << 20  # of text in one block
TILE = 8192  # lines of one key in a tile
SLAB = 1 << 18  # pairs looked at together
BROADCAST_LINES = 200_000


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def parity(lines: list[str]) -> np.ndarray:
    """For each line 32 bits: whether characters of that class occur an odd number of times."""
    sizes = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(lines), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.bitwise_xor.reduceat(np.uint32(1) << (points & 31), starts)
    return out


def digests(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each normalized line: a hash, and an id of 32 more hash bits and its parity."""
    both = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    high = np.array([b >> 64 for b in both], np.uint64)
    low = np.array([b & 0xFFFFFFFF for b in both], np.uint64)
    return high, low << np.uint64(32) | parity(lines)


@lru_cache(maxsize=4_096)
def plan(chars: int, edits: int, least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, end, seed) of the segments of a line of this length, and of its other probes.

    A probe of a line shorter by ``d`` starts at most i - 1 places from segment i's own start, counted
    from the left, and at most edits + 1 - i counted from the right: the segments before and after it
    take the other edits.
    """
    own, probes = [], []
    for d in range(edits + 1):
        n = chars - d
        if n < least:
            break
        size, longer = divmod(n, edits + 1)
        at = 0
        for i in range(1, edits + 2):
            length = size + (i > edits + 1 - longer)
            seed = n * (edits + 1) + i
            left, right = i - 1, edits + 1 - i
            for start in range(max(0, at - left, at + d - right), min(chars - length, at + left, at + d + right) + 1):
                (own if d == 0 and start == at else probes).append((start, start + length, seed))
            at += length
    return own, probes


def keys_of(line: str, spans: list[tuple[int, int, int]]) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    if line.isascii():
        raw = line.encode()
        return [digest(raw[a:b], seed) for a, b, seed in spans]
    return [digest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed in spans]


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Sorted words as differences, byte by byte: the high bytes are mostly zero."""
    planes = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, id_of, uid, text): every row as a struct and what names it; written, so that names hold.

    Repeated rows share their name, the doc_id and the hash of their text. Without a doc_id the row's
    number is its name.
    """
    uid = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), uid.alias("uid"))
    return stage(rows, "line_rows").select(
        "row", F.col("row.doc_id").cast("bigint").alias("id_of"), "uid", F.col("row.text").alias("text")
    )


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, uid, line_no, lead, high, id) of every line that isn't blank; written.

    ``lead`` marks the first such line of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in row_blocks(batches, most=BLOCK_BYTES):
            doc_ids, uids, numbers, leads, lines = [], [], [], [], []
            for doc, uid, text in zip(*(block.column(c).to_pylist() for c in ("id_of", "uid", "text"))):
                lead = True
                for n, line in enumerate(map(normal, (text or "").split("\n"))):
                    if line:
                        doc_ids.append(doc)
                        uids.append(uid)
                        numbers.append(n)
                        leads.append(lead)
                        lines.append(line)
                        lead = False
            high, ids = digests(lines)
            yield pa.record_batch(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(uids, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    pa.array(leads, pa.bool_()),
                    pa.array(high.view(np.int64)),
                    pa.array(ids.view(np.int64)),
                ],
                ["doc_id", "uid", "line_no", "lead", "high", "id"],
            )

    found = rows.select("id_of", "uid", "text").mapInArrow(
        run, "doc_id bigint, uid bigint, line_no int, lead boolean, high bigint, id bigint"
    )
    return stage(found, "lines")


def bucketed_keys(docs: DataFrame, buckets: int, edits: int, least: int) -> DataFrame:
    """Index and probe keys of the different lines of each block, by hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in row_blocks(batches, most=BLOCK_BYTES):
            lines = list(
                {n for text in block.column("text").to_pylist() for n in map(normal, (text or "").split("\n")) if len(n) >= least}
            )
            if not lines:
                continue
            _, ids = digests(lines)
            packed = []
            for which in (0, 1):
                spans = [plan(len(x), edits, least)[which] for x in lines]
                keys = np.array([k for x, s in zip(lines, spans) for k in keys_of(x, s)], np.uint64)
                owner = np.repeat(ids, [len(s) for s in spans])
                bucket = keys % np.uint64(buckets)
                order = np.lexsort((keys, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
                packed.append((keys[order], owner[order], cuts))
            rows = []
            for b in np.flatnonzero(sum(np.diff(cuts) for _, _, cuts in packed)).tolist():
                row = [b]
                for keys, owner, cuts in packed:
                    a, z = cuts[b], cuts[b + 1]
                    row += [squeeze_sorted(keys[a:z]), owner[a:z].tobytes()]
                rows.append(row)
            names = ["bucket", "keys", "ids", "probes", "probe_ids"]
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, ids binary, probes binary, probe_ids binary")


def without_repeats(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))[: len(keys)]
    return keys[new], ids[new]


def close(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether two ids may belong to different lines within reach: an edit changes two parities."""
    return (a != b) & (np.bitwise_count((a ^ b) & np.uint64(0xFFFFFFFF)) <= 2 * edits)


def matches(bucket: pa.Table, edits: int) -> pa.Table:
    """Candidate pairs of one bucket, and the lines of keys that many lines share.

    Pairs have both ``a`` and ``b``, and no ``key``. Lines of such a key come in pieces of ``TILE``, those that
    probe as ``a`` and those of the index as ``b``; every piece of the one meets every piece of the other
    in a join on the key.
    """

    def column(keys: str, ids: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [expand_sorted(x) for x in bucket.column(keys).to_pylist()]
        owners = [np.frombuffer(x, np.uint64) for x in bucket.column(ids).to_pylist()]
        return without_repeats(np.concatenate(parts), np.concatenate(owners))

    keys, ids = column("keys", "ids")
    probes, probe_ids = column("probes", "probe_ids")
    # lines with a segment in common probe each other as well: those further on in the key
    first, last = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
    ahead = np.searchsorted(keys, keys, "right")
    asking = np.concatenate([probe_ids, ids])
    low = np.concatenate([first, np.arange(1, len(keys) + 1)])
    size = np.concatenate([last - first, ahead - np.arange(1, len(keys) + 1)])
    hot, left, right = [], [], []

    if len(keys):
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(starts[1:], len(keys))
        asked = np.searchsorted(probes, keys[starts], "right") - np.searchsorted(probes, keys[starts], "left")
        crowded = np.flatnonzero(ends - starts + asked > TILE)
        for k in crowded.tolist():
            own = ids[starts[k] : ends[k]]
            begin = np.searchsorted(probes, keys[starts[k]], "left")
            ask = np.concatenate([probe_ids[begin : begin + asked[k]], own])
            asks = [ask[i : i + TILE].tobytes() for i in range(0, len(ask), TILE)]
            owns = [own[i : i + TILE].tobytes() for i in range(0, len(own), TILE)]
            hot += [int(keys[starts[k]].view(np.int64))] * (len(asks) + len(owns))
            left += asks + [None] * len(owns)
            right += [None] * len(asks) + owns
            size[np.isin(np.concatenate([probes, keys]), keys[starts[k]])] = 0

    some = np.flatnonzero(size)
    asking, low, size = asking[some], low[some], size[some]
    for a, b in ranges(np.cumsum(size), SLAB):
        n = size[a:b]
        one = np.repeat(asking[a:b], n)
        other = ids[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ok = close(one, other, edits)
        if ok.any():
            hot.append(None)
            left.append(one[ok].tobytes())
            right.append(other[ok].tobytes())
    return pa.table(
        {"key": pa.array(hot, pa.int64()), "a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())}
    )


def ranges(running: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(running):
        done = running[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(running, done + most, "right")))
        yield start, end
        start = end


def candidates(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """Distinct (a, b), a < b: ids of lines that share a segment and may be within reach."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(default_parts(docs.sparkSession), -(-volume // BUCKET_BYTES))
    found = (
        bucketed_keys(docs, buckets, edits, least)
        .groupBy("bucket")
        .applyInArrow(lambda t: matches(t, edits), "key bigint, a binary, b binary")
    )
    found = stage(found, "line_matches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c], np.uint64) for c in ("a", "b"))
                if row["key"] is not None:
                    for i in range(0, len(a), 256):
                        some = a[i : i + 256]
                        x, y = np.nonzero(close(some[:, None], b[None, :], edits))
                        yield pairs(some[x], b[y])
                else:
                    yield pairs(a, b)

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    asks, owns = found.where("b IS NULL").drop("b"), found.where("a IS NULL").drop("a")
    tiles = asks.join(owns.hint("merge"), "key").repartition(default_parts(docs.sparkSession))
    both = found.where("key IS NULL").unionByName(tiles)
    return stage(both.mapInArrow(run, "a bigint, b bigint").distinct(), "line_candidates")


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``, by a bit vector that follows the diagonal.

    The vector has the cells of a column that lie within ``most`` of the diagonal; bits say whether
    neighbouring cells differ by plus or minus one. The distance is followed along the lower edge of
    the band and then along the last row.
    """
    n = min(len(a), len(b))
    skip = 0
    while skip < n and a[skip] == b[skip]:
        skip += 1
    tail = 0
    while tail < n - skip and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[skip : len(a) - tail], b[skip : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    if not b:
        return True
    if len(a) <= most:
        return True  # replacing everything is cheap enough
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * most + 2
    full = (1 << width) - 1
    up, down, cost = full & (full << (width - most - 1)), 0, most
    edge, row = 1 << (width - 1), 1 << (width - 2)
    for i, c in enumerate(b):
        shift = i + most - width + 1
        same = places.get(c, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & full
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right_up = down | (full & ~(zero | up))
        right_down = zero & up
        if i < len(a) - most:
            cost += not zero & edge
        else:
            cost += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        up = right_down | (full & ~((zero >> 1) | right_up))
        down = (zero >> 1) & right_up
    return cost <= most


def verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """(a, b): first occurrences (doc_id, uid, line_no) of lines within ``edits``; written.

    Only the documents in which a candidate line occurs first are read again.
    """
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = stage(
        firsts.join(ids, "id").groupBy("doc_id", "uid").agg(
            F.collect_list(F.struct("line_no", "high", "id")).alias("lines")
        ),
        "wanted_lines",
    )
    small = wanted.select(F.sum(F.size("lines"))).first()[0] or 0
    side = F.broadcast(wanted) if small <= BROADCAST_LINES else wanted
    source = docs.select("id_of", F.col("uid").alias("uid_of"), "text")
    same = source["id_of"].eqNullSafe(side["doc_id"]) & (source["uid_of"] == side["uid"])
    rows = source.join(side, same).select("doc_id", "uid", "text", "lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in row_blocks(batches, most=BLOCK_BYTES):
            out = []
            for row in block.to_pylist():
                lines = (row["text"] or "").split("\n")
                for w in row["lines"]:
                    if w["line_no"] < len(lines):
                        out.append((w["id"], w["high"], row["doc_id"], row["uid"], w["line_no"], normal(lines[w["line_no"]])))
            if not out:
                continue
            high, ids = digests([x[5] for x in out])
            # rows whose texts have the same hash may have other lines there
            right = (high.view(np.int64) == np.array([x[1] for x in out])) & (ids.view(np.int64) == np.array([x[0] for x in out]))
            columns = list(zip(*(x for x, ok in zip(out, right.tolist()) if ok))) or [()] * 6
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "high", "doc_id", "uid", "line_no", "line"])

    texts = stage(rows.mapInArrow(cut, "id bigint, high bigint, doc_id bigint, uid bigint, line_no int, line string"), "line_texts")
    place = F.struct("doc_id", "uid", "line_no")
    one = texts.select(F.col("id").alias("a"), place.alias("first_a"), F.col("line").alias("line_a"))
    two = texts.select(F.col("id").alias("b"), place.alias("first_b"), F.col("line").alias("line_b"))
    both = pairs.join(one, "a").join(two, "b").select("first_a", "first_b", "line_a", "line_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()
            ok = pa.array([within(x, y, edits) for x, y in zip(left, right)], pa.bool_())
            yield batch.select(["first_a", "first_b"]).filter(ok)

    node = "struct<doc_id:bigint,uid:bigint,line_no:int>"
    checked = both.mapInArrow(check, f"first_a {node}, first_b {node}")
    return stage(checked.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")), "line_links")


def duplicates(rows: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, uid, drop (numbers of the lines that go), n_lines, n_linked of every document with lines.

    ``rows`` are numbered. ``n_linked`` counts lines that have another text within reach.
    """
    found = occurrences(rows)
    here = F.struct("doc_id", "uid", "line_no")
    firsts = stage(
        found.groupBy("high", "id").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")),
        "line_firsts",
    )
    spread = firsts.select("high", "id", "first.doc_id", "first.uid", "first.line_no")
    links = verified(rows, spread, candidates(rows, edits, least), edits)
    labels = connected_components(links)
    known = firsts.join(labels, firsts["first"] == labels["node"], "left").where("n > 1 OR label IS NOT NULL")
    known = stage(
        known.select("high", "id", F.coalesce("label", "first").alias("keeper"), F.col("label").isNotNull().alias("linked")),
        "line_classes",
    )
    marked = found.join(known, ["high", "id"], "left")
    goes = F.when(F.col("keeper").isNotNull() & (here != F.col("keeper")), F.col("line_no"))
    # repeated rows have the same lines
    copies = F.greatest(F.lit(1), F.count(F.when(F.col("lead"), 1)))
    each = lambda n: F.floor(n / copies).cast("bigint")
    return marked.groupBy("doc_id", "uid").agg(
        F.collect_set(goes).alias("drop"),
        each(F.count(F.lit(1))).alias("n_lines"),
        each(F.count(F.when(F.col("linked"), 1))).alias("n_linked"),
    )


def drop_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """Every row as a struct ``row``, its text without the lines that go, and the counts."""
    rows = numbered(docs)
    facts = stage(duplicates(rows, edits, least), "line_facts")
    full = rows.select("row", "id_of", F.col("uid").alias("uid_of"), F.col("text").alias("full"))
    # by shuffle at every size: what goes grows with the documents
    same = full["id_of"].eqNullSafe(F.col("doc_id")) & (full["uid_of"] == F.col("uid"))
    joined = full.join(facts.hint("merge"), same, "left")
    # a column, so that a text is split once and not again for each line
    joined = joined.withColumn("lines", F.when(F.size("drop") > 0, F.split("full", "\n", -1)))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.array_join(F.transform(F.array_except(every, "drop"), lambda i: F.get("lines", i)), "\n")
    text = F.when(F.size("drop") > 0, kept).otherwise(F.col("full"))
    return joined.select(
        "row",
        text.alias("text"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
