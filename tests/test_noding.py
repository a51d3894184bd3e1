"""Noded unions of lines: closed forms, random networks against exact fractions, main lines."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from riverplane.operators import lines, noding


def segments_of(spark, rows):
    return spark.createDataFrame([("n", line, i, *map(float, (*p, *q))) for line, pts in enumerate(rows) for i, (p, q) in enumerate(zip(pts, pts[1:], strict=False))], "by string, line int, seq int, x1 double, y1 double, x2 double, y2 double")


def pieces_of(df):
    return sorted(tuple(sorted([(round(r.x1, 4), round(r.y1, 4)), (round(r.x2, 4), round(r.y2, 4))])) for r in df.collect())


def test_cross_tee_and_doubles(spark):
    cross = [[(0, 0), (10, 10)], [(0, 10), (10, 0)]]
    assert len(pieces_of(noding.node_lines(segments_of(spark, cross)))) == 4
    tee = [[(0, 0), (10, 0)], [(4, 0), (4, 5)]]
    assert pieces_of(noding.node_lines(segments_of(spark, tee))) == [((0, 0), (4, 0)), ((4, 0), (4, 5)), ((4, 0), (10, 0))]
    slanted = [[(0, 0), (9, 3)], [(3, 1), (3, 5)]]
    assert len(pieces_of(noding.node_lines(segments_of(spark, slanted)))) == 3
    doubled = [[(0, 0), (10, 0)], [(6, 0), (2, 0), (2, 3)], [(10, 0), (0, 0)]]
    assert pieces_of(noding.node_lines(segments_of(spark, doubled))) == [((0, 0), (2, 0)), ((2, 0), (2, 3)), ((2, 0), (6, 0)), ((6, 0), (10, 0))]
    assert pieces_of(noding.node_lines(segments_of(spark, [[(1, 1), (1, 1)], [(0, 0), (1, 0)]]))) == [((0, 0), (1, 0))]
    assert noding.node_lines(segments_of(spark, [[(0, 0), (1, 0)]]).limit(0)).count() == 0


def plain_union(rows):
    """All pairs, in exact fractions."""
    segs = [tuple((Fraction(x), Fraction(y)) for x, y in s) for pts in rows for s in zip(pts, pts[1:], strict=False) if s[0] != s[1]]
    out = set()
    for p, q in segs:
        dx, dy = q[0] - p[0], q[1] - p[1]
        at = {Fraction(0), Fraction(1)}
        for a, b in segs:
            ex, ey = b[0] - a[0], b[1] - a[1]
            den = dx * ey - dy * ex
            if den:
                t, u = ((a[0] - p[0]) * ey - (a[1] - p[1]) * ex) / den, ((a[0] - p[0]) * dy - (a[1] - p[1]) * dx) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    at.add(t)
            elif (a[0] - p[0]) * dy == (a[1] - p[1]) * dx:
                at |= {t for c in (a, b) if 0 <= (t := ((c[0] - p[0]) * dx + (c[1] - p[1]) * dy) / (dx * dx + dy * dy)) <= 1}
        points = [(round(float(p[0] + dx * t), 4), round(float(p[1] + dy * t), 4)) for t in sorted(at)]
        out |= {tuple(sorted(x)) for x in zip(points, points[1:], strict=False)}
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_networks_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [[(rng.randint(0, 24), rng.randint(0, 24)) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows += [rows[0][::-1], rows[1][1:3], [(0, 5), (24, 5)], [(10, 5), (30, 5)]]
    got = noding.node_lines(segments_of(spark, rows))
    assert pieces_of(got) == plain_union(rows)
    chained = noding.chains(got).collect()
    degree = Counter(n for r in chained for n in (r.a, r.b))
    by_chain = {}
    for r in sorted(chained, key=lambda r: (r.line, r.seq, r.t)):
        by_chain.setdefault(r.chain, []).append(r)
    for own in by_chain.values():
        assert len({r.line for r in own}) == 1 and all(x.b == y.a and degree[x.b] == 2 for x, y in zip(own, own[1:], strict=False))


def test_main_line_of_crossing_rivers(spark):
    # A spur crosses the river: its longest piece ends at the crossing. A doubled stretch, turned round, changes nothing.
    river = [(0, i, 10.0 * i, 0.0) for i in range(31)]
    spur = [(1, 0, 205.0, -30.0), (1, 1, 205.0, 30.0)]
    again = [(2, i, 10.0 * (25 - i), 0.0) for i in range(5)]
    rows = [(7, *r) for r in river + spur + again] + [(8, 0, i, 5.0 * i, 900.0 + (i % 2)) for i in range(5)]
    got = lines.main_line(spark.createDataFrame(rows, "river_id int, part int, seq int, x double, y double")).orderBy("river_id", "seq").collect()
    assert [(r.seq, r.x, r.y) for r in got if r.river_id == 7] == [(i, 10.0 * i, 0.0) for i in range(21)] + [(21, 205.0, 0.0)]
    assert [(r.x, r.y) for r in got if r.river_id == 8] == [(5.0 * i, 900.0 + (i % 2)) for i in range(5)]


def test_main_line_runs_as_most_of_its_lines(spark):
    parts = [(0, [(0, 0), (10, 0)]), (1, [(20, 0), (10, 0)]), (2, [(30, 0), (20, 0)])]
    rows = [(1, p, i, float(x), float(y)) for p, pts in parts for i, (x, y) in enumerate(pts)]
    got = lines.main_line(spark.createDataFrame(rows, "river_id int, part int, seq int, x double, y double")).orderBy("seq").collect()
    assert [r.x for r in got] == [30.0, 20.0, 10.0, 0.0]


def test_dissolve_gives_lines(spark):
    rows = [("a", 0, 0, 0.0, 0.0), ("a", 0, 1, 4.0, 0.0), ("a", 0, 2, 8.0, 0.0), ("a", 1, 0, 6.0, -3.0), ("a", 1, 1, 6.0, 3.0), ("b", 0, 0, 0.0, 0.0), ("b", 0, 1, 1.0, 1.0)]
    got = lines.dissolve_lines(spark.createDataFrame(rows, "name string, line int, seq int, x double, y double")).orderBy("name", "line_no", "seq").collect()
    assert [tuple(r) for r in got] == [
        ("a", 0, 0, 0.0, 0.0), ("a", 0, 1, 4.0, 0.0), ("a", 0, 2, 6.0, 0.0), ("a", 1, 0, 6.0, 0.0), ("a", 1, 1, 8.0, 0.0),
        ("a", 2, 0, 6.0, -3.0), ("a", 2, 1, 6.0, 0.0), ("a", 3, 0, 6.0, 0.0), ("a", 3, 1, 6.0, 3.0), ("b", 0, 0, 0.0, 0.0), ("b", 0, 1, 1.0, 1.0),
    ]
