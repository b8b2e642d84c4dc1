"""The page detector against a loop over bands, on hand-made halves and drawn ones."""

import random

from mnemos.operators import layout

HX, BX = (40.0, 230.0), (30.0, 220.0, 410.0)


def cells(marks, given, rows):
    """marks, given: {(row, col): owner}."""
    held, out = [None, None], []
    for r in range(rows):
        if (r, 0) in marks:
            held = [marks[r, 0], marks.get((r, 1), marks[r, 0])]
        elif (r, 1) in marks:
            held[1] = marks[r, 1]
        for c in (0, 1):
            held[c] = given.get((r, c), held[c])
        out.append(tuple(held))
    return out


def boxes(owners, ys):
    found = {}
    for r, (left, right) in enumerate(owners):
        own = [(left, 0, 2)] if left and left == right else [(left, 0, 1), (right, 1, 2)]
        for owner, a, b in own:
            if owner:
                box, known = [BX[a], ys[r], BX[b], ys[r + 1]], found.setdefault(owner, [])
                if known and (known[-1][0], known[-1][2], known[-1][3]) == (box[0], box[2], box[1]):
                    known[-1][3] = box[3]
                else:
                    known.append(box)
    return found


def test_owners_and_regions_against_the_loop(spark):
    rng, marks, given = random.Random(1), {}, {}
    for page in range(150):
        for r in range(3):
            for c in range(2):
                if rng.random() < 0.4:
                    marks.setdefault(page, {})[r, c] = str(rng.randint(1, 5))
                if rng.random() < 0.15:
                    given.setdefault(page, {})[r, c] = str(rng.randint(1, 5))
        marks.setdefault(page, {(0, 0): "9"})
    flat = lambda of: [(p, 0, r, c, o) for p, own in of.items() for (r, c), o in own.items()]
    held = layout.owners(spark.createDataFrame(flat(marks), "page int, side int, row int, col int, number string"), spark.createDataFrame(flat(given), "page int, side int, row int, col int, owner string"), 3)
    got = {}
    for x in held.collect():
        got.setdefault(x.page, {})[x.row] = (x.left, x.right)
    want = {p: cells(own, given.get(p, {}), 3) for p, own in marks.items()}
    assert {p: [own[r] for r in range(3)] for p, own in got.items()} == want
    ys = [100.0, 200.0, 310.0, 400.0]
    halves = spark.createDataFrame([(p, 0, 0.0, ys) for p in marks], "page int, side int, offset double, ys array<double>")
    found = {}
    for x in sorted(layout.regions(held, halves, BX).collect()):
        found.setdefault((x.page, x.number), []).append([x.x0, x.y0, x.x1, x.y1])
    assert found == {(p, o): own for p, owners in want.items() for o, own in boxes(owners, ys).items()}
    assert any(len(own) > 1 for own in found.values())


def test_a_page(spark):
    """Three headings, one too small, one repeated, one unread, a workspace; a band that moves; a page without anything."""
    line = lambda text, x, y, h=16.0, page=1: (page, text, x, y, x + 20.0, y + h)
    lines = [line("1", 41.0, 104.0), line("2", 231.0, 103.0), line(" 3", 39.0, 207.0), line("4", 41.0, 303.0, 9.0), line("I", 229.0, 304.0, 18.0), line("Nebenrechnung Aufgabe 2 :", 50.0, 350.0), line("Nebenrechnung Aufgabe 7:", 300.0, 250.0), line("29", 229.0, 204.0), line("text", 300.0, 304.0)]
    halves = spark.createDataFrame([(1, 0, 0.0, [100.0, 200.0, 300.0, 400.0], 2), (2, 1, 0.0, [100.0, 200.0, 300.0, 400.0], 0)], "page int, side int, offset double, ys array<double>, supported int")
    found, unread = layout.detected(spark.createDataFrame(lines, "page int, text string, x0 double, y0 double, x1 double, y1 double"), halves, HX, BX)
    got = sorted((r.number, r.seq, r.x0, r.y0, r.x1, r.y1, r.confidence, r.anchor) for r in found.collect())
    # 29 is above the largest number, but short and tall is no heading either: 16 is less than an unread one needs
    assert got == [
        ("1", 1, 30.0, 100.0, 220.0, 202.0, 0.96, "h0-r0-c0"), ("2", 1, 220.0, 100.0, 410.0, 202.0, 0.84, "h0-r0-c1"), ("2", 2, 30.0, 303.0, 220.0, 400.0, 0.84, "h0-r0-c1"), ("3", 1, 30.0, 202.0, 410.0, 303.0, 0.96, "h0-r1-c0"),
    ]
    assert [(r.page, r.anchor) for r in unread.collect()] == [(1, "h0-r2-c1")]
