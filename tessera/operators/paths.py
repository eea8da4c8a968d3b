"""Path data: reading every command of the grammar into lines and cubics, and writing it in few bytes.

A path is a list of subpaths; a subpath is its start, its segments and whether it is closed. A
segment is (x, y) for a line or (x1, y1, x2, y2, x, y) for a cubic, absolute. Quadratics and
arcs become cubics. Path data that breaks the grammar keeps what comes before the fault.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_GAP = re.compile(r"[\s,]*")
# How many numbers each command takes.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


@dataclass
class Subpath:
    start: tuple[float, float]
    segments: list[tuple[float, ...]] = field(default_factory=list)
    closed: bool = False


def commands(d: str) -> Iterator[tuple[str, list[float]]]:
    """Each command with its numbers, repeats written out (further pairs of a move are lines)."""
    at, letter = _GAP.match(d).end(), ""
    while at < len(d):
        if d[at].isalpha():
            letter = d[at]
            if letter.upper() not in TAKES:
                return
            at = _GAP.match(d, at + 1).end()
            if letter in "Zz":
                yield letter, []
                letter = ""
                continue
        elif not letter:
            return
        values: list[float] = []
        for k in range(TAKES[letter.upper()]):
            if letter in "Aa" and k in (3, 4):  # flags are single digits
                if at >= len(d) or d[at] not in "01":
                    return
                values.append(float(d[at]))
                at = _GAP.match(d, at + 1).end()
                continue
            m = _NUMBER.match(d, at)
            if m is None:
                return
            values.append(float(m[0]))
            at = _GAP.match(d, m.end()).end()
        yield letter, values
        letter = {"M": "L", "m": "l"}.get(letter, letter)


def arc_cubics(x0: float, y0: float, rx: float, ry: float, turn: float, large: bool, sweep: bool, x: float, y: float) -> list[tuple[float, ...]]:
    """An elliptical arc as cubics of at most a quarter turn."""
    rx, ry = abs(rx), abs(ry)
    if (x0, y0) == (x, y):
        return []
    if not rx or not ry:
        return [(x, y)]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    hx, hy = (x0 - x) / 2, (y0 - y) / 2
    u, v = (c * hx + s * hy) / rx, (c * hy - s * hx) / ry
    reach = u * u + v * v
    if reach > 1:
        rx, ry, u, v, reach = rx * math.sqrt(reach), ry * math.sqrt(reach), u / math.sqrt(reach), v / math.sqrt(reach), 1.0
    off = math.sqrt(max(0.0, 1 / reach - 1)) * (-1 if large == sweep else 1)
    cu, cv = off * v, -off * u
    first, last = math.atan2(v - cv, u - cu), math.atan2(-v - cv, -u - cu)
    span = (last - first) % (2 * math.pi) if sweep else -((first - last) % (2 * math.pi))
    mx, my = (x0 + x) / 2 + c * rx * cu - s * ry * cv, (y0 + y) / 2 + s * rx * cu + c * ry * cv
    pieces = max(1, math.ceil(abs(span) / (math.pi / 2) - 1e-9))
    step = span / pieces
    k = 4 / 3 * math.tan(step / 4)
    out = []
    for i in range(pieces):
        a, b = first + i * step, first + (i + 1) * step
        spots = [(math.cos(a) - k * math.sin(a), math.sin(a) + k * math.cos(a)), (math.cos(b) + k * math.sin(b), math.sin(b) - k * math.cos(b)), (math.cos(b), math.sin(b))]
        out.append(tuple(w for p, q in spots for w in (mx + c * rx * p - s * ry * q, my + s * rx * p + c * ry * q)))
    out[-1] = (*out[-1][:4], x, y)
    return out


def parse_path(d: str | None) -> list[Subpath]:
    found: list[Subpath] = []
    pen = start = (0.0, 0.0)
    open_: Subpath | None = None
    control, kind = None, ""
    for letter, v in commands(d or ""):
        upper, ox, oy = letter.upper(), *(pen if letter.islower() else (0.0, 0.0))
        if upper == "M":
            pen = start = (ox + v[0], oy + v[1])
            open_ = None
        elif upper == "Z":
            if open_ is not None:
                if math.dist(pen, start) > 1e-9:
                    open_.segments.append(start)
                open_.closed = True
            pen, open_ = start, None
        else:
            if open_ is None:
                # After a close the next subpath begins where the last one did.
                open_, start = Subpath(pen), pen
                found.append(open_)
            mirrored = (2 * pen[0] - control[0], 2 * pen[1] - control[1]) if control is not None else pen
            if upper in "LHV":
                to = (ox + v[0], oy + v[1]) if upper == "L" else (ox + v[0], pen[1]) if upper == "H" else (pen[0], oy + v[0])
                made, control = [to], None
            elif upper in "CS":
                one = (ox + v[0], oy + v[1]) if upper == "C" else mirrored if kind in "CS" else pen
                two, to = (ox + v[-4], oy + v[-3]), (ox + v[-2], oy + v[-1])
                made, control = [(*one, *two, *to)], two
            elif upper in "QT":
                q = (ox + v[0], oy + v[1]) if upper == "Q" else mirrored if kind in "QT" else pen
                to = (ox + v[-2], oy + v[-1])
                made, control = [tuple(a + 2 / 3 * (b - a) for p in (pen, to) for a, b in zip(p, q, strict=True)) + to], q
            else:
                to = (ox + v[5], oy + v[6])
                made, control = arc_cubics(*pen, v[0], v[1], v[2], bool(v[3]), bool(v[4]), *to), None
            open_.segments += [m for m in made if len(m) == 6 or math.dist(m, pen) > 1e-12]
            pen = to
        kind = upper if upper in "CSQT" else ""
        if not kind:
            control = None
    return [s for s in found if s.segments]


def number(v: float, digits: int) -> str:
    """The shortest decimal: no trailing zeros, no leading zero, no minus zero."""
    text = f"{v:.{digits}f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    text = re.sub(r"^(-?)0\.", r"\1.", text)
    return "0" if text in ("-0", "", "-") else text


def _joined(parts: list[str]) -> str:
    """Numbers with a blank only where the grammar needs one."""
    out = ""
    for p in parts:
        needs = out and not out[-1].isalpha() and not p.startswith("-") and not (p.startswith(".") and "." in re.split(r"[\s-]|(?<=\d)(?=\.)(?=.*\.)", out)[-1])
        out += (" " if needs else "") + p
    return out


def write_path(subpaths: list[Subpath], digits: int = 2) -> str:
    """Path data in few bytes: of each segment the shorter of its absolute and relative form, letters left out where they repeat.

    Positions run over rounded values, so relative forms don't drift.
    """

    def snap(v: float) -> float:
        return float(f"{v:.{digits}f}") + 0.0

    out, letter, pen = "", "", (0.0, 0.0)

    def add(forms: list[tuple[str, list[float]]]) -> None:
        nonlocal out, letter
        best = None
        for name, values in forms:
            text = _joined([number(v, digits) for v in values])
            if name == letter:
                tail = re.search(r"[^A-Za-z\s-]*$", out)[0]
                glue = "" if text.startswith("-") or not out or (text.startswith(".") and tail.count(".") > 0 and "." in tail.split(" ")[-1]) else " "
            else:
                glue = name
            if best is None or len(glue + text) < len(best[0]):
                best = (glue + text, name)
        out += best[0]
        letter = best[1]

    for sub in subpaths:
        start = (snap(sub.start[0]), snap(sub.start[1]))
        add([("M", [*start]), ("m", [start[0] - pen[0], start[1] - pen[1]])])
        letter = {"M": "L", "m": "l"}[letter]
        pen = start
        last = len(sub.segments) - 1
        for i, seg in enumerate(sub.segments):
            v = [snap(x) for x in seg]
            to = (v[-2], v[-1])
            if len(v) == 2 and sub.closed and i == last and to == start:
                break  # closing draws it
            off = [x - pen[k % 2] for k, x in enumerate(v)]
            if len(v) == 6:
                add([("C", v), ("c", off)])
            elif to[1] == pen[1] and to != pen:
                add([("H", v[:1]), ("h", off[:1])])
            elif to[0] == pen[0] and to != pen:
                add([("V", v[1:]), ("v", off[1:])])
            else:
                add([("L", v), ("l", off)])
            pen = to
        if sub.closed:
            out += "z"
            letter, pen = "", start
    return out


SEGMENTS = "line_id bigint, subpath int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x double, y double, closed boolean"


def segment_rows(paths: DataFrame, digits: int = 6, rewritten: bool = False) -> DataFrame:
    """Every segment of path data (line_id, d), with null controls for lines; `rewritten`: of the data written again in few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                subpaths = parse_path(d)
                if rewritten:
                    subpaths = parse_path(write_path(subpaths))
                for n, sub in enumerate(subpaths):
                    pen = sub.start
                    for k, seg in enumerate(sub.segments):
                        values = [round(v, digits) + 0.0 for v in (*pen, *seg)]
                        controls = values[2:6] if len(seg) == 6 else [None] * 4
                        rows.append((i, n, k, "cubic" if len(seg) == 6 else "line", *values[:2], *controls, *values[-2:], sub.closed))
                        pen = seg[-2:]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 8, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return paths.select("line_id", "d").mapInArrow(run, SEGMENTS)


def minified(paths: DataFrame, digits: int = 2) -> DataFrame:
    """line_id, d in few bytes, and the bytes before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(1).to_pylist()
            after = [write_path(parse_path(d), digits) for d in before]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(after, pa.string()), pa.array([len(d or "") for d in before], pa.int32()), pa.array([len(d) for d in after], pa.int32())], names=["line_id", "d", "bytes_before", "bytes_after"])

    return paths.select("line_id", "d").mapInArrow(run, "line_id bigint, d string, bytes_before int, bytes_after int")
