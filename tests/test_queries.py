"""Every registered query that SQL can state, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from tessera.operators import dense as D
from tessera.plans import load, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

load.all_plans()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want


def test_skeleton_of_a_tile_that_takes_more_rounds_than_the_sql(spark, tmp_path):
    tile = ".#####.# #######. ######## ##.##### #.#.#### ##..#### #.###..# ######..".split()
    ink = np.array([[c == "#" for c in row] for row in tile])
    rows = [(7, [float(c) - 0.5 for c in ink.ravel()]), (8, [0.5] * 64), (9, [-0.5] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT image_id, x, y, v FROM ({registry.oracle_sql()['skeleton']})").fetchall())
    assert sorted(tuple(r) for r in registry.queries()["skeleton"](spark, str(tmp_path)).select("image_id", "x", "y", "v").collect()) == want
    # The kernel goes on until nothing changes, unless a number of rounds is asked for.
    whole = D.thinned(ink)
    assert (D.thinned(whole) == whole).all() and (D.thinned(ink, 7) == whole).all() and (D.thinned(ink, 6) != whole).sum() == 1


def settled(ink):
    """Zhang and Suen's thinning pixel by pixel, until a whole round deletes nothing; also the rounds that deleted."""
    on = {(x, y) for y, row in enumerate(ink) for x, c in enumerate(row) if c}
    rounds = 0
    while True:
        before = len(on)
        for second in (False, True):
            gone = set()
            for x, y in on:
                if 0 < x < len(ink[0]) - 1 and 0 < y < len(ink) - 1:
                    p = [(x + dx, y + dy) in on for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
                    n, e, s, w = p[::2]
                    kept = (n and e and w) or (n and s and w) if second else (n and e and s) or (e and s and w)
                    if 2 <= sum(p) <= 6 and sum(not p[k] and p[(k + 1) % 8] for k in range(8)) == 1 and not kept:
                        gone.add((x, y))
            on -= gone
        if len(on) == before:
            return {(x, y, float((x, y) in on)) for y, row in enumerate(ink) for x in range(len(row))}, rounds
        rounds += 1


def test_skeleton_goes_on_until_nothing_changes(spark, tmp_path):
    tiles = {
        3: "####..## #####..# ####.#.# ######## ######## ######## #.#####. .###.##.",
        7: ".#####.# #######. ######## ##.##### #.#.#### ##..#### #.###..# ######..",
        8: "######## ######## ######## ######## ######## ######## ######## ########",
    }
    inks = {k: [[c == "#" for c in row] for row in v.split()] for k, v in tiles.items()}
    want = {k: settled(ink) for k, ink in inks.items()}
    assert [want[k][1] for k in (3, 7)] == [11, 7]
    rows = [(k, [float(c) - 0.5 for row in ink for c in row]) for k, ink in inks.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted((k, *cell) for k, (cells, _) in want.items() for cell in cells)
    assert sorted(tuple(r) for r in registry.queries()["skeleton"](spark, str(tmp_path)).select("image_id", "x", "y", "v").collect()) == want
    assert sorted(con.execute(f"SELECT image_id, x, y, v FROM ({registry.oracle_sql()['skeleton']})").fetchall()) == want


def test_entry_point_lists_the_same_queries():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
