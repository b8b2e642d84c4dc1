"""Pixels against loops over numpy arrays."""

import math
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from mnemos.operators import raster


def page(seed, high=70, wide=50):
    rng = np.random.default_rng(seed)
    img = rng.integers(150, 256, (high, wide))
    for cy in (20, 45):
        r = np.hypot(*np.mgrid[-cy : high - cy, -25 : wide - 25])
        img[(r >= 8) & (r <= 11.8)] = rng.integers(0, 140)
        img[r <= 3] = 30
    return img


def table(spark, pages):
    rows = [(p, y, x, int(v)) for p, img in pages.items() for (y, x), v in np.ndenumerate(img)]
    return spark.createDataFrame(rows, "page int, y int, x int, v int")


def test_adaptive_ink_and_rings(spark):
    pages = {1: page(1), 2: page(2, 61, 55)}
    df = table(spark, pages)
    ink = raster.adaptive_ink(df, [3, 9])
    got = {(r.page, r.threshold, r.y, r.x): r.ink for r in ink.collect()}
    masks = {}
    for p, img in pages.items():
        for c in (3, 9):
            mask = masks[p, c] = np.zeros(img.shape, bool)
            for y, x in np.ndindex(*img.shape):
                near = img[max(0, y - 15) : y + 16, max(0, x - 15) : x + 16]
                mask[y, x] = img[y, x] * near.size <= near.sum() - c * near.size
    assert got == {(p, c, y, x): bool(v) for (p, c), m in masks.items() for (y, x), v in np.ndenumerate(m)}

    centres = [(p, "c", i, 25.0 + dx, cy + 0.25) for p in pages for i, (dx, cy) in enumerate([(0, 20), (1.5, 45), (-20, 20)], 1)]
    found = raster.rings(ink, spark.createDataFrame(centres, "page int, item string, row int, cx double, cy double"), raster.ADAPTIVE).collect()
    want = {}
    for p, _, i, cx, cy in centres:
        y0, x0 = round(cy) - 13, round(cx) - 13
        for c in (3, 9):
            m = masks[p, c]
            if x0 < 0:
                continue
            yy, xx = np.mgrid[y0 : y0 + 27, x0 : x0 + 27]
            r, k = np.hypot(xx - cx, yy - cy), ((np.arctan2(yy - cy, xx - cx) + math.pi) / (2 * math.pi) * 12).astype(int) % 12
            on, inked = (r >= 8) & (r <= 11.8), m[yy, xx]
            want[p, i, c] = round(inked[on].mean(), 4), round(sum(inked[on & (k == s)].mean() >= 0.2 for s in range(12)) / 12, 4), round(inked[r <= 3].mean(), 4)
    got = {(r.page, r.row, r.threshold): (r.ring_ink, r.angular_support, r.center_ink) for r in found}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    assert len(want) == 8


def test_centres_move_to_the_dark(spark):
    img = page(3)
    df = table(spark, {1: img})
    got = raster.snapped(df, spark.createDataFrame([(1, "c", 1, 23.0, 18.0), (1, "c", 2, 27.0, 47.0), (1, "c", 3, 10.0, 33.0)], "page int, item string, row int, cx double, cy double")).collect()
    for r, (x, y) in zip(sorted(got, key=lambda r: r.row), [(23, 18), (27, 47), (10, 33)], strict=True):
        _, oy, ox = min((img[y + a - 2 : y + a + 3, x + b - 2 : x + b + 3].mean(), a, b) for a in range(-3, 4) for b in range(-3, 4))
        assert (r.cx, r.cy) == (x + ox, y + oy)


def test_decisions(spark):
    """One strong row, none, two, a possible other, a small margin, a missing dot, thresholds that disagree, too few rows, no measurement."""
    base = {r: (0.1, 0.2, 0.5) for r in range(1, 6)}
    cases = {
        "fine": ([base | {2: (0.8, 1.0, 0.5)}] * 2, 2), "none": ([base] * 2, None), "two": ([base | {2: (0.8, 1.0, 0.5), 4: (0.8, 1.0, 0.5)}] * 2, None), "other": ([base | {2: (0.8, 1.0, 0.5), 4: (0.42, 0.6, 0.5)}] * 2, None),
        "margin": ([base | {2: (0.5, 1.0, 0.5), 4: (0.4, 0.1, 0.5)}] * 2, None), "wide": ([base | {2: (0.55, 1.0, 0.5), 4: (0.4, 0.1, 0.5)}] * 2, 2), "dot": ([base | {2: (0.8, 1.0, 0.5), 5: (0.1, 0.1, 0.05)}] * 2, None),
        "differ": ([base | {2: (0.8, 1.0, 0.5)}, base | {3: (0.8, 1.0, 0.5)}], None), "four": ([{r: v for r, v in (base | {2: (0.8, 1.0, 0.5)}).items() if r < 5}] * 2, None), "one": ([base | {2: (0.8, 1.0, 0.5)}], None),
    }
    rows = [(1, name, r, t, *v) for name, (own, _) in cases.items() for t, m in enumerate(own) for r, v in m.items()]
    measured = spark.createDataFrame(rows, "page int, item string, row int, threshold int, ring_ink double, angular_support double, center_ink double")
    columns = spark.createDataFrame([(1, n, True) for n in (*cases, "absent")] + [(2, "fine", False)], "page int, item string, numbered boolean")
    got = {(r.page, r.item): (r.answer, r.reasons) for r in raster.decided(measured, columns, raster.TWOFOLD).collect()}
    assert {n: got[1, n][0] for n in cases} == {n: a for n, (_, a) in cases.items()}
    assert got[1, "margin"][1] == ["insufficient_margin"] and got[1, "differ"][1] == ["threshold_disagreement"] and "five_dots_not_clear" in got[1, "four"][1]
    assert got[1, "absent"][0] is None and "question_number_uncertain" in got[2, "fine"][1]


def test_segments_and_seams(spark):
    img = np.full((60, 90), 220)
    for x in range(5, 85):
        if not 30 <= x < 33 and not 50 <= x < 60:
            img[20 + x // 45, x] = 10
    img[45:47, 10:40] = 0
    df = table(spark, {1: img, 2: np.full((8, 8), 9)})
    cells = raster.edges(df, 100)
    step = np.abs(np.diff(img, axis=0)) >= 100
    assert {(r.y, r.x) for r in cells.collect()} == {(int(y) + 1, int(x)) for y, x in zip(*np.nonzero(step))}
    want = set()
    for a in range(-12, 13):
        t, bins = math.radians(a / 10), defaultdict(list)
        for y, x in zip(*np.nonzero(step)):
            bins[math.floor(round((y + 1) * math.cos(t) - x * math.sin(t), 9) + 0.5)].append((int(x), int(y) + 1))
        for offset, own in bins.items():
            if len(own) < 12:
                continue
            own, piece = sorted(own), []
            for c in [*own, (10**6, 0)]:
                if piece and c[0] - piece[-1][0] > 5:
                    if piece[-1][0] - piece[0][0] >= 8:
                        want.add((1, a, offset, piece[0][0], piece[-1][0], piece[0][1], piece[-1][1]))
                    piece = []
                piece.append(c)
    found = raster.segments(cells, 12, 8, 5)
    assert {(r.page, r.angle, r.offset, r.x0, r.x1, r.y0, r.y1) for r in found.collect()} == want and len(want) > 20
    bands = spark.createDataFrame([(1, 1, 22, 0, 20, 80), (1, 2, 44, 0, 20, 80), (1, 3, 30, 0, 20, 80), (2, 1, 4, 0, 9, 9)], "page int, band int, nominal int, lo int, hi int, end int")
    got = {(r.page, r.band): (r.seam, r.supported) for r in raster.seams(found, bands, 6, 20).collect()}
    best = {}
    for b, nominal in ((1, 22), (2, 44), (3, 30)):
        fits = [(x1 - x0, -(y0 + y1) / 2) for _, _, _, x0, x1, y0, y1 in want if abs(y1 - y0) < 4 and abs((y0 + y1) / 2 - nominal) < 6 and x0 <= 20 and x1 <= 80 and x1 - x0 > 20]
        best[1, b] = (-max(fits)[1], True) if fits else (nominal, False)
    assert got == best | {(2, 1): (4.0, False)} and not best[1, 3][1]


def brute_picture(pages, regions, gap):
    panels = []
    for p in dict.fromkeys(r[1] for r in sorted(regions)):
        own = [r for r in sorted(regions) if r[1] == p]
        left, top = min(r[2] for r in own), min(r[3] for r in own)
        panel = np.full((max(r[5] for r in own) - top, max(r[4] for r in own) - left), 255, np.uint8)
        for _, _, x0, y0, x1, y1 in own:
            cut = pages[p][y0:y1, x0:x1]
            panel[y0 - top : y0 - top + cut.shape[0], x0 - left : x0 - left + cut.shape[1]] = cut
        panels.append(panel)
    wide = max(p.shape[1] for p in panels)
    rows = []
    for i, p in enumerate(panels):
        rows += [np.pad(p, ((0, 0), (0, wide - p.shape[1])), constant_values=255)] + [np.full((gap, wide), 255, np.uint8)] * (i + 1 < len(panels))
    return np.vstack(rows)


@pytest.mark.parametrize("gap", [0, 3])
def test_composed_pictures(spark, gap):
    rng = np.random.default_rng(5)
    pages = {p: rng.integers(0, 250, (12, 16)).astype(np.uint8) for p in range(4)}
    regions = {}
    for q in range(12):
        for seq in range(rng.integers(1, 6)):
            x0, y0 = (int(v) for v in rng.integers(0, 14, 2))
            regions.setdefault(q, []).append((seq, int(rng.integers(0, 4)), x0, min(y0, 11), x0 + int(rng.integers(1, 9)), min(y0, 11) + int(rng.integers(1, 5))))
    rows = spark.createDataFrame([(p, y, bytearray(r.tobytes())) for p, img in pages.items() for y, r in enumerate(img)], "page int, y int, bytes binary")
    df = spark.createDataFrame([(q, "o", *r) for q, own in regions.items() for r in own] + [(90, None, 1, 1, 0, 0, 2, 2), (91, "a", 1, 1, 0, 0, 2, 2), (91, "b", 2, 1, 0, 0, 2, 2)], "question int, owner string, seq int, page int, x0 int, y0 int, x1 int, y1 int")
    drawn = raster.composed(rows, df, gap)
    got = {}
    for r in sorted(drawn.collect()):
        got.setdefault(r.question, []).append(bytes(r.bytes))
    want = {q: brute_picture(pages, own, gap) for q, own in regions.items()}
    assert got == {q: [r.tobytes() for r in img] for q, img in want.items()}
    hashes = {r.question: (r.width, r.height, r.sha256) for r in raster.picture_hashes(drawn).collect()}
    assert hashes == {q: (img.shape[1], img.shape[0], sha256(f"{img.shape[1]}x{img.shape[0]}:".encode() + img.tobytes()).hexdigest()) for q, img in want.items()}
    assert {(r.question, r.problem) for r in raster.refused(df).collect()} == {(90, "unresolved"), (91, "mixed")}


@pytest.mark.parametrize("num,den", [(5, 2), (1, 1), (2, 3)])
def test_scaled(spark, num, den):
    img = np.arange(7 * 9, dtype=np.uint8).reshape(7, 9)
    rows = spark.createDataFrame([(1, y, bytearray(r.tobytes())) for y, r in enumerate(img)], "page int, y int, bytes binary")
    high, wide = -(-7 * num // den), -(-9 * num // den)
    want = img[np.arange(high) * den // num][:, np.arange(wide) * den // num]
    assert {r.y: bytes(r.bytes) for r in raster.scaled_rows(rows, num, den).collect()} == {y: r.tobytes() for y, r in enumerate(want)}
    assert raster.pixels(rows).count() == img.size
