"""Line dedup, SimHash near-dedup and connected components, against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from txnlens.llm import line_dedup, simhash
from txnlens.llm.components import connected_components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n, letters="abc "):
    out = list(text)
    for _ in range(n):
        at = rng.randint(0, len(out))
        kind = rng.choice("ids")
        if kind == "i" or not out:
            out.insert(at, rng.choice(letters))
        elif kind == "d":
            out.pop(min(at, len(out) - 1))
        else:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def test_within():
    rng = random.Random(3)
    for _ in range(8000):
        a = "".join(rng.choices("abé", k=rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 5))
        most = rng.randint(0, 4)
        assert line_dedup.within(a, b, most) == (distance(a, b) <= most)
    long = "word " * 40_000
    assert line_dedup.within(long, "x" + long[:-1], 2) and not line_dedup.within(long, "xyz" + long, 2)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_in_reach_share_a_key_and_parity(edits):
    rng = random.Random(edits)
    for _ in range(1500):
        a = "".join(rng.choices("abcdef ghé", k=rng.randint(20, 60)))
        b = edited(rng, a, edits)
        a, b = sorted((a, b), key=len)
        if len(a) < 20 or a == b:
            continue
        own = line_dedup.keys_of(a, line_dedup.plan(len(a), edits, 20)[0])
        probes = line_dedup.plan(len(b), edits, 20)
        assert set(own) & set(line_dedup.keys_of(b, probes[0] + probes[1]))
        ids = line_dedup.digests([a, b])[1]
        assert line_dedup.close(ids[:1], ids[1:], edits).all()


def brute_lines(rows, edits=line_dedup.EDITS, least=line_dedup.MIN_CHARS):
    """{doc_id: (kept text, lines, dropped, linked)}; doc_ids differ."""
    first = {}
    places = [(d, n, line_dedup.normal(x)) for d, t in rows for n, x in enumerate((t or "").split("\n"))]
    for d, n, x in sorted(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        if x:
            first.setdefault(x, (d is not None, d or 0, n))
    long = sorted((x for x in first if len(x) >= least), key=len)
    links = [(a, b) for i, a in enumerate(long) for b in long[i + 1 :] if len(b) - len(a) <= edits and distance(a, b) <= edits]
    of = {v: k for k, v in first.items()}
    keeper = roots([*of], [(first[a], first[b]) for a, b in links])
    linked = {x for pair in links for x in pair}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        norm = [line_dedup.normal(x) for x in lines]
        keep = [not x or keeper[first[x]] == (d is not None, d or 0, n) for n, x in enumerate(norm)]
        kept = "\n".join(x for x, k in zip(lines, keep) if k)
        out[d] = (t if t is None else kept, sum(map(bool, norm)), keep.count(False), sum(x in linked for x in norm))
    return out


def got_lines(df):
    return {r["row"]["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["n_linked"]) for r in df.collect()}


def test_line_dedup_against_brute_force(documents):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefg h", k=rng.randint(15, 50))) for _ in range(30)]
    rows = []
    for doc in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 6))]
        rows.append((doc, "\n".join(lines + rng.choice([[], ["", " "], ["short"], ["Short "]]))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, base[0] + "\n" + "z" * 1500), (103, "y" + "z" * 1499)]
    got = got_lines(line_dedup.drop_lines(documents(rows)))
    assert got == brute_lines(rows)


def test_line_dedup_edges(documents):
    assert line_dedup.drop_lines(documents([])).collect() == []
    same = "one line that is long enough\nother"
    got = line_dedup.drop_lines(documents([(1, same), (1, same), (2, same)])).collect()
    assert sorted((r["row"]["doc_id"], r["text"]) for r in got) == [(1, same), (1, same), (2, "")]
    assert "a.b" in got[0]["row"].asDict()
    only_null = line_dedup.drop_lines(documents([(1, None), (2, None)])).collect()
    assert [r["text"] for r in only_null] == [None, None]


def test_rows_that_share_an_id_keep_their_own_lines(documents):
    def kept(rows):
        got = line_dedup.drop_lines(documents(rows)).collect()
        assert all(r["n_lines"] == len(r["row"]["text"].split("\n")) for r in got)
        assert all(r["n_lines"] - r["n_dropped"] == len(r["text"].split("\n")) * (r["text"] != "") for r in got)
        return sorted(x for r in got for x in r["text"].split("\n") if x)

    for doc in (None, 7):
        rows = [(doc, "unique1\ncommon"), (doc, "common\nunique2"), (doc, "far\nunique1\nunique3"), (8, "common\nx")]
        assert kept(rows) == ["common", "far", "unique1", "unique2", "unique3", "x"]
    near = "a line that is near the others in text "
    # rows without an id are documents of their own even if their texts are the same
    assert len(kept([(None, near + "1\nb"), (None, near + "1\nb"), (None, "c\n" + near + "2"), (3, near + "3")])) == 3
    counts = [(r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_lines(documents([(1, "a\na"), (1, "a\na")])).collect()]
    assert counts == [(2, 1), (2, 1)]


def test_many_lines_with_a_segment_in_common(documents):
    """More lines than a tile holds share their beginning; every twentieth has a line within two edits."""
    n = line_dedup.TILE + 500
    lines = ["https://host.example/the/same/path/of/all?id=" + xxhash.xxh3_128_hexdigest(str(i)) for i in range(n)]
    near = [edited(random.Random(i), lines[i], 2, "0123456789") for i in range(0, n, 20)]
    rows = [(k, "\n".join(lines[k::50])) for k in range(50)] + [(1000, "\n".join(near)), (1001, lines[7])]
    got = got_lines(line_dedup.drop_lines(documents(rows)))
    assert [got[k][2] for k in range(50)] == [0] * 50
    assert got[1000] == ("", len(near), len(near), len([i for i, x in enumerate(near) if x != lines[20 * i]]))
    assert got[1001][0] == ""


def test_work_on_lines_grows_with_the_text(documents):
    def seconds(n):
        text = "\n".join(f"{i:x}" for i in range(n)) + "\n1"
        began = time.monotonic()
        got = got_lines(line_dedup.drop_lines(documents([(1, text), (2, "1\n2\nzzz")])))
        assert got[1] == (text[:-2], n + 1, 1, 0) and got[2] == ("zzz", 3, 2, 0)
        return time.monotonic() - began

    seconds(1_000)
    assert seconds(100_000) < 2.3 * seconds(50_000) + 2


def test_crowded_keys_are_cut_into_tiles(monkeypatch):
    rng = random.Random(4)
    lines = list({"a shared beginning of the line " + "".join(rng.choices("ab", k=12)) for _ in range(300)})
    lines = [x for x in lines if len(x) == len(lines[0])]
    ids = line_dedup.digests(lines)[1]

    def bucket(which):
        spans = [line_dedup.plan(len(x), 2, 20)[which] for x in lines]
        keys = np.array([k for x, s in zip(lines, spans) for k in line_dedup.keys_of(x, s)], np.uint64)
        owner = np.repeat(ids, [len(s) for s in spans])
        order = np.argsort(keys)
        return line_dedup.squeeze_sorted(keys[order]), owner[order].tobytes()

    (keys, own), (probes, asking) = bucket(0), bucket(1)
    table = pa.table({"keys": [keys], "ids": [own], "probes": [probes], "probe_ids": [asking]})

    def found(tile):
        monkeypatch.setattr(line_dedup, "TILE", tile)
        out, kinds = set(), set()
        rows = line_dedup.matches(table, 2).to_pylist()
        asks, owns = ([r for r in rows if r["key"] is not None and r[c] is not None] for c in ("a", "b"))
        pairs = [r for r in rows if r["key"] is None]
        pairs += [{**a, "b": b["b"]} for a in asks for b in owns if a["key"] == b["key"]]
        # what a crowded key leaves grows with its lines, not with their square
        assert sum(len(r[c]) for r, c in [*((r, "a") for r in asks), *((r, "b") for r in owns)]) <= 8 * (2 * len(own) // 8 + len(asking) // 8)
        for row in pairs:
            kinds.add(int(row["key"] is not None))
            a, b = (np.frombuffer(row[c], np.uint64) for c in ("a", "b"))
            if row["key"] is not None:
                x, y = np.nonzero(line_dedup.close(a[:, None], b[None, :], 2))
                a, b = a[x], b[y]
            out |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
        return out, kinds

    plain, tiled = found(10**6), found(16)
    assert plain[0] == tiled[0] and plain[1] == {0} and 1 in tiled[1]
    of = dict(zip(ids.tolist(), lines))
    near = {(min(a, b), max(a, b)) for a in of for b in of if a < b and distance(of[a], of[b]) <= 2}
    assert near <= plain[0]


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(6)
    texts = ["", " \t\n", "One", "one two", "A b\x0bC", "é\xa0É x y", "a b c " * 400]
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 700))) for _ in range(20)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_print(t) for t in texts]


def test_long_document_is_hashed_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefghij", k=5000))
    monkeypatch.setattr(simhash, "HASHES", 64)
    assert simhash.fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_near_lanes(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64, 200, np.uint64)
    fps[50:150] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 100, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100, np.uint64))
    word, query = np.divmod(np.arange(4 * 200), 200)
    hits = simhash.near_lanes(simhash.planes_of(fps), word, fps[query], radius)
    hits = np.concatenate([hits, np.zeros(len(word) - len(hits), np.uint64)])
    for w, q, h in zip(word, query, hits.tolist()):
        lanes = fps[w * 64 : w * 64 + 64]
        want = sum(1 << i for i, f in enumerate(lanes.tolist()) if (f ^ int(fps[q])).bit_count() <= radius)
        assert h & ((1 << len(lanes)) - 1) == want


@pytest.mark.parametrize("tile_rows", [4, 10_000])
def test_links_connect_all_near_fingerprints(spark, tile_rows):
    rng = random.Random(tile_rows)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for _ in range(200):
        fps.add(rng.choice([*fps]) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    links = [(r["a"], r["b"]) for r in simhash.near_links(nodes, tile_rows=tile_rows).collect()]
    bits = dict(zip(signed, fps))
    assert all((bits[a] ^ bits[b]).bit_count() <= 64 and a != b for a, b in links)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if (bits[a] ^ bits[b]).bit_count() <= 2]
    assert roots(signed, links) == roots(signed, near)


def test_near_dedup_edges(documents, by_doc):
    text = " ".join(random.Random(2).choices("abcdefghijklmnop", k=300))
    rows = [(5, text), (3, text), (3, text), (None, text), (8, None), (7, ""), (9, " \n"), (None, "by itself"), (10, "x " * 100_000)]
    got = by_doc(simhash.near_dedup(documents(rows)))
    assert {r["component_id"] for r in got[5] + got[3]} == {3}
    assert {r["component_id"] for r in got[7] + got[8] + got[9]} == {7}
    assert sorted(map(str, (r["component_id"] for r in got[None]))) == ["3", "None"]
    assert len(got[3]) == 2 and got[8][0]["fp"] == 0
    assert simhash.near_dedup(documents([])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(7, x) for x in range(8, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(1, 1)]
    rng.shuffle(links)
    got = connected_components(spark.createDataFrame([*links, (None, 4)], "a bigint, b bigint"))
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert {r["node"]: r["label"] for r in got.collect()} == roots(nodes, [p for p in links if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
