"""PCM WAV headers and payloads from bytes; other codecs are behind a pluggable function."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType


def wav_seconds(data: bytes | None) -> float | None:
    """Duration from the header; null if the bytes are no WAV."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, TypeError, ZeroDivisionError):
        return None


def wav_bytes(samples: bytes, rate: int, channels: int = 1, width: int = 2) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def audio_seconds(data: Column, other: Callable[[bytes], float | None] | None = None) -> Column:
    """Durations of audio bytes in Arrow batches; ``other`` measures what is no WAV."""

    def measure(batch: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> float | None:
            seconds = wav_seconds(b)
            return other(b) if seconds is None and other is not None and b is not None else seconds

        return batch.map(one).astype("float64")

    return F.pandas_udf(measure, DoubleType())(data)


def silence(frames: Column, rate: Column) -> Column:
    """WAV bytes of silent mono samples."""

    def make(number: pd.Series, hertz: pd.Series) -> pd.Series:
        return pd.Series([wav_bytes(b"\0\0" * int(n), int(r)) for n, r in zip(number, hertz)], dtype=object)

    return F.pandas_udf(make, BinaryType())(frames, rate)
