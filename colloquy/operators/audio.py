"""Measures of short windows of sound, given as samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the frames, in seconds.
FRAME, HOP = 0.025, 0.010


def frames(samples: np.ndarray, rate: int) -> np.ndarray:
    size, hop = max(1, int(FRAME * rate)), max(1, int(HOP * rate))
    if len(samples) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]


def snr_db(x: np.ndarray) -> float | None:
    """The loudest tenth of the frames over the quietest fifth, in decibels; nothing of silence."""
    loudness = np.sort(np.sqrt((x**2).mean(1)))
    loudness = loudness[np.isfinite(loudness)]
    if not len(loudness):
        return None
    noise, speech = loudness[: max(1, len(loudness) // 5)].mean(), loudness[-max(1, len(loudness) // 10) :].mean()
    return None if noise <= 1e-12 or speech <= 1e-12 else 20 * math.log10(speech / noise)


def overlap(x: np.ndarray) -> float:
    """The share of voiced frames that are twice as loud as the median one and cross zero half as often again."""
    if len(x) < 4:
        return 0.0
    loudness = np.sqrt((x**2).mean(1))
    crossing = (np.signbit(x[:, 1:]) != np.signbit(x[:, :-1])).mean(1)
    if loudness.max() <= 1e-12:
        return 0.0
    voiced = loudness >= max(0.05 * loudness.max(), float(np.percentile(loudness, 25)))
    if voiced.sum() < 4:
        return 0.0
    loudness, crossing = loudness[voiced], crossing[voiced]
    odd = loudness >= 2 * np.median(loudness)
    if np.median(crossing) > 0:
        odd &= crossing >= 1.5 * np.median(crossing)
    return float(odd.mean())


def measures(windows: DataFrame, key: str, rate: int = 16_000) -> DataFrame:
    """(key, snr_db, overlap) of windows (key, samples)."""
    kind = windows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            cut = [frames(np.asarray(s if s is not None else [], float), rate) for s in pdf["samples"]]
            yield pd.DataFrame({key: pdf[key], "snr_db": [snr_db(x) if len(x) else None for x in cut], "overlap": [overlap(x) for x in cut]})

    return windows.select(key, "samples").mapInPandas(run, f"{key} {kind}, snr_db double, overlap double")
