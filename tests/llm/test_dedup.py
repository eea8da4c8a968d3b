import hashlib
import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, lines, neardup, suffixes
from tests.llm.conftest import words


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, similarity):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= similarity * len(a | b) and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


@pytest.mark.parametrize("blocks", [(1024, 192), (4, 3)])
def test_near_duplicates(spark, awkward, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "SIGNATURE_BLOCK", blocks[0])
    monkeypatch.setattr(neardup, "SET_BLOCK", blocks[1])
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    base = words(rng, 120).split()
    for n in range(40):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(50)}"
        rows.append((1000 + n, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, similarity in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, k, similarity).collect()}
        assert got == brute_components(rows, k, similarity)


def test_near_duplicates_of_awkward_tables(awkward, nothing):
    assert neardup.near_duplicates(awkward).count() == awkward.count()
    assert neardup.near_duplicates(nothing).count() == 0
    left = neardup.one_of_each(awkward)
    assert left.columns == awkward.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 18 in ids and 21 not in ids and 27 not in ids and ids.count(18) == 1


def test_shingles_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, 700), " ".join(["again and"] * 300), "x" * 5000, "one  two\n", " " * 900, "a " * 50 + "y" * 800 + " b c d"]
    for k in (1, 2, 3, 5):
        whole = [neardup.shingles(pa.array([t]), k)[0].tolist() for t in texts]
        with monkeypatch.context() as m:
            for segment in (1, 7, 100, 333):
                m.setattr(neardup, "SEGMENT", segment)
                assert [neardup.shingles(pa.array([t]), k)[0].tolist() for t in texts] == whole


def test_width_of_passages(nothing):
    for width in (10, 2000):
        with pytest.raises(ValueError):
            suffixes.dedup_passages(nothing, width)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)])
    s = neardup.circulant_signatures(np.concatenate([a, b]), np.array([0, 3000, 6000]))
    assert abs((s[0] == s[1]).mean() - 2400 / 3600) < 0.15
    assert neardup.rows_of_band(85) >= neardup.rows_of_band(80) >= 3


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (7, 7), (200, 150)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 150: 150, 200: 150}


def test_components_of_long_shuffled_chains(spark):
    rng = random.Random(8)
    ids = list(range(4000))
    rng.shuffle(ids)
    chains = [ids[:3000], ids[3000:]]
    links = [(a, b) for chain in chains for a, b in itertools.pairwise(chain)]
    rng.shuffle(links)
    rows = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == 4000 and {r["node"]: r["component"] for r in rows} == {i: min(chain) for chain in chains for i in chain}


def brute_passages(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(b[s : s + width])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_passages(spark, awkward, monkeypatch, most):
    """With most = 2 nearly every bucket is dealt out by its strings' hashes."""
    monkeypatch.setattr(suffixes, "MOST", most)
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"]) for r in awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    passage = words(rng, 25)
    rows += [(500 + n, words(rng, rng.randrange(30)) + passage[rng.randrange(20) :] + words(rng, rng.randrange(30))) for n in range(30)]
    rows += [(600, "ab" * 400), (601, "a" * 99), (602, "a" * 100), (603, "a" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_passages(df).collect()}
    assert got == brute_passages(rows, 100)


def test_passages_of_awkward_tables(awkward, nothing):
    assert suffixes.dedup_passages(awkward).count() == awkward.count()
    assert suffixes.dedup_passages(nothing).count() == 0


def test_long_texts_are_read_in_segments(monkeypatch):
    raw = np.frombuffer(words(random.Random(4), 900).encode(), np.uint8)
    bounds = np.array([0, 1000, 1000, len(raw)])
    whole = suffixes.stretches(raw, bounds)
    monkeypatch.setattr(suffixes, "_SEGMENT", 333)
    cut = suffixes.stretches(raw, bounds)

    def covered(s):
        return sorted((o, i) for o, a, n in zip(*s[:3], strict=True) for i in range(a, a + n))

    assert covered(whole) == covered(cut)


def test_suffix_sort():
    rng = random.Random(6)
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(700)), np.uint8)
    starts = np.arange(600)
    bucket = np.repeat([0, 1, 2], [350, 249, 1])
    got, runs = suffixes.sorted_runs(raw, starts, bucket, 40)
    want = sorted(starts, key=lambda i: (bucket[i], raw[i : i + 40].tobytes(), i))
    assert got.tolist() == want
    texts = [(b, raw[i : i + 40].tobytes()) for b, i in zip(bucket, got, strict=True)]
    assert (np.diff(runs) == [int(a != b) for a, b in itertools.pairwise(texts)]).all()


def brute_lines(rows, least=1):
    """Of each document what is left, the deleted lines, their runs and the longest repeated run: every run of `least` lines whose first copy is elsewhere goes."""
    docs = {i: [(n, x.strip(" ")) for n, x in enumerate((t or "").split("\n")) if x.encode().split()] for i, t in rows}
    seen, gone, longest = {}, {i: set() for i in docs}, dict.fromkeys(docs, 0)
    for i in sorted(docs):
        seq = [x for _, x in docs[i]]
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                key = tuple(seq[a:b])
                if seen.setdefault(key, (i, a)) != (i, a):
                    longest[i] = max(longest[i], b - a)
                    if b - a >= least:
                        gone[i] |= set(range(a, b))
    out = {}
    for i, t in rows:
        cut = {docs[i][k][0] for k in gone[i]}
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in cut)
        out[i] = (left, len(cut), sum(k - 1 not in gone[i] for k in gone[i]), 1 << longest[i].bit_length() >> 1)
    return out


def line_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    rows += [(700, "a b c\nd e f\ng h i j\nk l"), (701, "zz\na b c\nd e f\ng h i j\nq"), (702, "a b c\n\nd e f\ng h i j"), (703, "a b c\nd e f"), (704, "k l\n" * 9), (705, "x\ny\nx\ny\nx\ny\nx")]
    rng = random.Random(12)
    return rows + [(800 + n, "\n".join(rng.choice("pqrst") for _ in range(rng.randrange(12)))) for n in range(25)]


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines(spark, awkward, least):
    rows = line_rows(awkward)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"] or "", r["__n_removed"], r["__n_runs"], r["__depth"]) for r in lines.dedup_lines(df, least, depth=True).collect()}
    assert got == brute_lines(rows, least)


def test_lines_like_sql(spark, awkward):
    rows = line_rows(awkward)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string").toPandas())
    want = {r[0]: r[1:] for r in con.execute(lines.SQL).fetchall()}
    assert {i: (w[1], w[2], w[3], w[4]) for i, w in want.items()} == {i: (*b[1:], hashlib.sha256(b[0].encode()).hexdigest()) for i, b in brute_lines(rows).items()}


def test_lines_of_awkward_tables(awkward, nothing):
    done = lines.dedup_lines(awkward)
    assert done.count() == awkward.count() and set(awkward.columns) < set(done.columns)
    assert lines.dedup_lines(nothing).count() == 0
    # A repeated row shares its places with the first and so keeps its text.
    assert len({r["text"] for r in done.filter("doc_id = 18").collect()}) == 1
