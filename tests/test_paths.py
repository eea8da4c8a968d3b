"""Path data: what is read, and that what is written reads back the same."""

import random

import pytest

from tessera.operators.paths import Subpath, number, parse_path, write_path


def flat(subpaths):
    return [(tuple(round(v, 6) for v in s.start), [tuple(round(v, 6) for v in g) for g in s.segments], s.closed) for s in subpaths]


def test_every_command():
    found = flat(parse_path("M1 2L3,4l1-1H9v-.5.5zM0 0q1 0 1 1t1 1s1 2 3 3a1 1 0 01 2 2"))
    assert found[0] == ((1, 2), [(3, 4), (4, 3), (9, 3), (9, 2.5), (9, 3), (1, 2)], True)
    assert found[1][1][:3] == [(0.666667, 0, 1, 0.333333, 1, 1), (1, 1.666667, 1.333333, 2, 2, 2), (2, 2, 3, 4, 5, 5)]
    assert found[1][1][-1][-2:] == (7, 7)


@pytest.mark.parametrize("d, n", [("", 0), (None, 0), ("M0 0", 0), ("L1 1", 1), ("M0 0L1 1 2", 1), ("M0 0L1 1X3", 1), ("M0 0A1 1 0 2 1 3 3L9 9", 0), ("m1 1 1 0 0 1z l1 1", 2), ("M0 0 1e1-2E-1", 1), ("M0 0A0 1 0 0 1 3 3", 1)])
def test_faults_and_edges(d, n):
    assert len(parse_path(d)) == n


def test_arcs_lie_on_their_circle():
    for large in "01":
        for sweep in "01":
            (path,) = parse_path(f"M0 0A5 5 0 {large} {sweep} 6 2")
            ends = [g[-2:] for g in path.segments]
            assert ends[-1] == (6, 2)
            pens = [(0.0, 0.0), *ends]
            # Middles of the cubics are as far from one centre as the ends.
            spots = [p for a, g in zip(pens, path.segments, strict=False) for p in (a, tuple((a[i] + 3 * g[i] + 3 * g[2 + i] + g[4 + i]) / 8 for i in (0, 1)))]
            (ax, ay), (bx, by), (cx, cy) = spots[0], spots[1], ends[-1]
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
            uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
            assert all(abs(((x - ux) ** 2 + (y - uy) ** 2) ** 0.5 - 5) < 0.01 for x, y in spots)


def test_written_paths_read_back():
    rng = random.Random(1)
    saved = 0
    for _ in range(1500):
        subs = []
        for _ in range(rng.randrange(1, 4)):
            value = lambda: rng.choice([rng.randrange(-30, 30) / 4, rng.randrange(-300, 300) / 100, float(rng.randrange(-3, 3))])
            subs.append(Subpath((value(), value()), [tuple(value() for _ in range(rng.choice([2, 6]))) for _ in range(rng.randrange(1, 6))], rng.random() < 0.5))
        plain = "".join(f"M{s.start[0]} {s.start[1]}" + "".join(("L" if len(g) == 2 else "C") + " ".join(map(repr, g)) for g in s.segments) + ("Z" if s.closed else "") for s in subs)
        short = write_path(subs)
        assert flat(parse_path(short)) == flat(parse_path(plain))
        saved += len(plain) - len(short)
    assert saved > 0 and [number(v, 2) for v in (0.5, -0.5, -0.001, 10.0, 1.25)] == [".5", "-.5", "0", "10", "1.25"]
