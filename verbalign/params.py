"""Parameters of a comparison, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CompareParams:
    """threshold: score of an OK row; tolerance: seconds between matched times; context: seconds around a segment."""

    threshold: float = 0.80
    tolerance: float = 1.5
    context: float = 2.0
    id_band: int = 2
    long_span: float = 6.0
    profile: str = "indel"

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        if self.profile not in ("indel", "difflib"):
            raise ValueError(f"unknown profile {self.profile!r}")


EFFORTS = {
    # Image variants and page modes by effort, in order.
    "fast": (("clahe_gray", "otsu", "inv_otsu"), (6,)),
    "balanced": (("clahe_gray", "otsu", "inv_otsu", "adaptive", "joined", "inv_joined"), (6, 7)),
    "accurate": (("clahe_gray", "otsu", "inv_otsu", "adaptive", "joined", "inv_joined"), (6, 7, 13)),
}


def check_effort(effort: str) -> str:
    if effort not in EFFORTS:
        raise ValueError(f"unknown effort {effort!r}; one of {tuple(EFFORTS)}")
    return effort


def check_crop_ratio(ratio: float) -> float:
    if not 0 < ratio <= 1:
        raise ValueError("crop ratio must be above 0 and at most 1")
    return ratio


def check_temperature(temperature: float) -> float:
    if not 0.0 <= float(temperature) <= 1.0:
        raise ValueError("temperature must be between 0.0 and 1.0")
    return round(float(temperature), 3)
