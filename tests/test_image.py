import numpy as np
import pytest

from tests import engines
from verbalign.functions import image as I
from verbalign.plans import pipeline
from verbalign.sources import adapters

RNG = np.random.default_rng(5)


def test_edges_follow_the_definition():
    g = RNG.integers(0, 256, (17, 23)).astype(np.uint8)
    g[4:9, 6:15] = 240
    p = np.pad(g.astype(int), 1, mode="edge")
    h, w = g.shape
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            n = p[y : y + 3, x : x + 3]
            dx[y, x] = (n[:, 2] - n[:, 0]) @ [1, 2, 1]
            dy[y, x] = (n[2] - n[0]) @ [1, 2, 1]
    size = abs(dx) + abs(dy)
    at = lambda y, x: size[y, x] if 0 <= y < h and 0 <= x < w else 0
    able = set()
    for y in range(h):
        for x in range(w):
            turn = np.degrees(np.arctan2(abs(dy[y, x]), abs(dx[y, x])))
            m = size[y, x]
            if turn < 22.5:
                top = m > at(y, x - 1) and m >= at(y, x + 1)
            elif turn > 67.5:
                top = m > at(y - 1, x) and m >= at(y + 1, x)
            elif (dx[y, x] < 0) == (dy[y, x] < 0):
                top = m > at(y - 1, x - 1) and m > at(y + 1, x + 1)
            else:
                top = m > at(y - 1, x + 1) and m > at(y + 1, x - 1)
            if top and m > 300:
                able.add((y, x))
    todo = [c for c in able if size[c] > 600]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for c in [(y + r, x + s) for r in (-1, 0, 1) for s in (-1, 0, 1)]:
            if c in able and c not in found:
                found.add(c)
                todo.append(c)
    assert found and {tuple(c) for c in np.argwhere(I.edges(g, 300, 600))} == found


def test_small_kernels():
    g = RNG.integers(0, 256, (6, 7)).astype(np.uint8)
    p = np.pad(g.astype(float), 1, mode="reflect")
    lap = [p[y, x + 1] + p[y + 2, x + 1] + p[y + 1, x] + p[y + 1, x + 2] - 4 * p[y + 1, x + 1] for y in range(6) for x in range(7)]
    assert I.sharpness(g) == pytest.approx(np.var(lap)) and I.sharpness(None) == 0.0
    assert I.sharpness(np.full((5, 5, 3), 9, np.uint8)) == 0.0

    def spread(t):  # variance between both sides
        a, b = g[g <= t], g[g > t]
        return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else -1

    assert I.otsu(g) == max(range(256), key=lambda t: (round(spread(t), 6), -t))
    assert I.gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[29, 150, 76]]
    row = np.array([[0, 255, 0, 255, 0, 0, 0, 255]], np.uint8)
    assert I.closed(row).tolist() == [[0, 255, 255, 255, 0, 0, 0, 255]]
    assert (I.smoothed(np.full((9, 9), 77, np.uint8)) == 77).all() and (I.enlarged(np.full((4, 5), 77, np.uint8), 3) == 77).all()
    # the kernel's weights at a quarter and three quarters of a pixel, on an impulse over grey 100
    dot = np.full((1, 9), 100, np.uint8)
    dot[0, 4] = 200
    near = {5: -0.03515625, 6: -0.10546875, 7: 0.26171875, 8: 0.87890625, 9: 0.87890625, 10: 0.26171875, 11: -0.10546875, 12: -0.03515625}
    want = [round(100 + 100 * near.get(x, 0)) for x in range(18)]
    assert I.enlarged(dot, 2)[0].tolist() == want
    step = np.repeat([[40, 200]], 8, axis=1).repeat(9, axis=0).astype(np.uint8)
    assert abs(I.smoothed(step)[:, 5].astype(int) - 40).max() <= 10  # the edge stays


def test_equalized_spreads_contrast():
    dull = RNG.integers(100, 120, (64, 80)).astype(np.uint8)
    out = I.equalized(dull)
    assert out.shape == dull.shape and out.std() > 2 * dull.std()
    flat = I.equalized(np.full((10, 11), 50, np.uint8))
    assert len(np.unique(flat)) == 1
    for shape in ((1, 1), (3, 50), (17, 8)):
        assert I.equalized(RNG.integers(0, 256, shape).astype(np.uint8)).shape == shape


def test_bounds_and_variants():
    f = engines.picture("caption", 200, 320, top=150)
    assert I.fixed_bounds(f, 0.15) == (0, 170, 320, 30)
    x, y, w, h = I.dynamic_bounds(f)
    assert (x, w) == (0, 320) and 110 <= y <= 150 and 160 <= y + h <= 200
    blank = np.zeros((200, 320, 3), np.uint8)
    assert I.dynamic_bounds(blank) == I.fixed_bounds(blank) and not I.captioned(blank)
    assert I.dynamic_bounds(np.zeros((10, 10), np.uint8)) == (0, 8, 10, 2)
    assert I.captioned(engines.picture("caption", 200, 320, top=165))
    made = I.variants(I.crop(f, (x, y, w, h)))
    assert list(made) == ["clahe_gray", "otsu", "inv_otsu", "adaptive", "joined", "inv_joined"]
    assert {m.shape for m in made.values()} == {(h * 3, 960)} and set(np.unique(made["otsu"])) <= {0, 255}
    assert (made["otsu"] == 255 - made["inv_otsu"]).all()
    assert list(I.variants(f, ("otsu",))) == ["otsu"] and I.variants(f[:0]) == {}
    assert I.retry_ratio(0.15) == pytest.approx(0.27) and I.retry_ratio(0.25) == 0.35 and I.retry_ratio(0.28) is None
    with pytest.raises(ValueError):
        I.fixed_bounds(None)
    with pytest.raises(ValueError):
        I.fixed_bounds(f, 0.0)


def test_screen_over_frames(spark):
    rows = [("low", 0, 1, 0.0, 2.0, 1.0, "caption here"), ("high", 0, 1, 0.0, 2.0, 1.0, "caption here"), ("gone", 0, 1, 0.0, 2.0, 1.0, "caption here"), ("bare", 0, 1, 0.0, 2.0, 1.0, "")]
    said = spark.createDataFrame(rows, "media_id string, seq long, id int, start double, end double, midpoint double, text string")
    got = {r.media_id: r for r in pipeline.screen(said, engines.ImageReader, "fast", source=engines.Shown, dynamic=False).collect()}
    assert got["low"].subtitle_text == "caption here" and got["low"].crop_region.asDict() == {"x": 0, "y": 170, "width": 320, "height": 30}
    assert got["low"].ocr_variant.endswith("/psm6")
    # nothing in the bottom band: the wider one is read
    assert got["high"].subtitle_text == "caption here" and got["high"].crop_region.height == 54
    assert got["gone"].status == "no_frame" and got["bare"].status == "empty"
    media = spark.createDataFrame([("low",), ("bare",), ("gone",)], "path string")
    seen = {r.media_id: (r.captioned, r.duration) for r in adapters.find_captions(media, engines.Shown).collect()}
    assert seen == {"low": (True, 9.0), "bare": (False, 9.0), "gone": (True, None)}
    assert {r.duration for r in adapters.probe_durations(media, "no-such-command").collect()} == {None}
