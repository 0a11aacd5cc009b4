"""Engines that the command tests name."""

import numpy as np

from verbalign.sources.adapters import FakeReader as Reader  # noqa: F401
from verbalign.sources.adapters import FakeRecogniser


class Careful(FakeRecogniser):
    def segments(self, path):
        if "broken" in path:
            raise ValueError("no sound in it")
        return super().segments(path)


def picture(kind, height, width, top):
    """A dark frame, with bars like letters from ``top`` on unless it is bare."""
    f = np.full((height, width, 3), 20, np.uint8)
    if kind != "bare":
        for x in range(20, width - 20, 8):
            f[top : top + 20, x : x + 4] = 230
    return f


class Shown:
    """Frames of items by name."""

    def frame(self, path, ts):
        return None if path == "gone" else picture(path, 200, 320, 148 if path == "high" else 175)

    def duration(self, path):
        return None if path == "gone" else 9.0


class ImageReader:
    """Reads bars as two words; all else as nothing."""

    def read(self, picture, psm):
        return [("caption", "90"), ("here", "90")] if np.ptp(picture) > 100 else []
