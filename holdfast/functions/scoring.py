"""Scores from 0 to 100 and how results are shown."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lowest phrase ratio, anchors of the scale, weights of one and two words, the floor, and steepness and default of calibration.
LEAST_RATIO = 0.72
ANCHORS = ((0.72, 88.0), (0.85, 99.0), (1.0, 100.0))
WORD_WEIGHTS = {1: 0.45, 2: 0.75}
FLOOR, STEEPNESS, UNCALIBRATED, LEAST_SPREAD = 70.0, 1.1, 50.0, 1e-6
VERBATIM_RATIO, STRONG, LIKELY, MOST_POSITION = 0.97, 80, 70, 86.0


def phrase_score(ratio: Column, words: Column | int = 3) -> Column:
    """Piecewise linear in the ratio, drawn towards the floor for one or two words."""
    n = F.lit(words) if isinstance(words, int) else words
    scale = F.when(ratio < LEAST_RATIO, 0.0)
    for (x0, y0), (x1, y1) in zip(ANCHORS, ANCHORS[1:], strict=False):
        scale = scale.when(ratio <= x1, y0 + (ratio - x0) * (y1 - y0) / (x1 - x0))
    base = scale.otherwise(ANCHORS[-1][1])
    weight = F.when(n <= 1, WORD_WEIGHTS[1]).when(n == 2, WORD_WEIGHTS[2]).otherwise(1.0)
    return F.when(ratio < LEAST_RATIO, 0.0).otherwise(FLOOR + (base - FLOOR) * weight)


def calibrated(similarity: Column, mean: Column, stddev: Column) -> Column:
    """A logistic curve over the z-score; without a calibration the middle of the scale."""
    usable = mean.isNotNull() & stddev.isNotNull() & (stddev >= LEAST_SPREAD)
    return F.when(usable, 100 / (1 + F.exp(-STEEPNESS * (similarity - mean) / stddev))).otherwise(UNCALIBRATED)


def calibrated_value(similarity: float, mean: float | None, stddev: float | None) -> float:
    """The same of one number."""
    if mean is None or stddev is None or stddev < LEAST_SPREAD:
        return UNCALIBRATED
    return 100 / (1 + math.exp(-STEEPNESS * (similarity - mean) / stddev))


def phrase_value(ratio: float, words: int) -> float:
    """phrase_score of one number."""
    if ratio < LEAST_RATIO:
        return 0.0
    base = float(np.interp(ratio, *zip(*ANCHORS, strict=True)))
    return FLOOR + (base - FLOOR) * WORD_WEIGHTS.get(max(words, 1), 1.0)


def z_score(x: Column, mean: Column, stddev: Column) -> Column:
    return (x - mean) / F.greatest(stddev, F.lit(LEAST_SPREAD))


def tier(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= LIKELY, "likely").otherwise("weak")


def verbatim(ratio: Column) -> Column:
    return F.coalesce(ratio > VERBATIM_RATIO, F.lit(False))


def match_position(ts: Column, duration: Column) -> Column:
    """Where in the medium the match is, in per cent; null without a duration."""
    return F.when(ts.isNotNull() & (duration > 0), F.least(F.lit(MOST_POSITION), ts / duration * 100))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def out_of_memory(error: Column) -> Column:
    e = F.lower(error)
    return e.contains("out of memory") | (e.contains("cuda error") & e.contains("memory"))
