"""Token estimates and padded costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens per second of audio, of speech, characters per text token, tokens of an unmeasured audio.
AUDIO_RATE, SPEECH_RATE, CHARS_PER_TOKEN, UNMEASURED_AUDIO = 17, 9, 4, 170
LENGTH_FIELDS = ("user_text_tokens", "assistant_text_tokens", "user_audio_tokens", "assistant_audio_tokens", "codec_tokens")
# Bounds of a duration in seconds, by role.
LEAST_SECONDS, MOST_SECONDS = 1.5, {"user": 30.0, "assistant": 60.0}


def total_length(lengths: Column) -> Column:
    """Sum of the five fields; null if one is null."""
    return sum((lengths[f].cast("long") for f in LENGTH_FIELDS[1:]), lengths[LENGTH_FIELDS[0]].cast("long"))


def text_chars(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))


def text_tokens(messages: Column) -> Column:
    return F.floor(text_chars(messages) / CHARS_PER_TOKEN).cast("long")


def finite(x: Column) -> Column:
    """``x`` unless it is NaN or infinite, then null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def audio_tokens(seconds: Column, rate: int = AUDIO_RATE) -> Column:
    """Whole tokens of an audio; null for an unknown or not finite duration."""
    return F.floor(finite(F.round(seconds, 3)) * rate).cast("long")


def row_estimate(messages: Column, durations: Column) -> Column:
    """Text tokens plus audio tokens, each audio cut to whole tokens."""
    audio = F.aggregate(durations, F.lit(0).cast("long"), lambda n, d: n + F.coalesce(audio_tokens(d), F.lit(0).cast("long")))
    return F.coalesce(text_tokens(messages), F.lit(0).cast("long")) + F.coalesce(audio, F.lit(0).cast("long"))


def column_estimate(estimate: Column, tokens: Column, durations: Column, audios: Column, messages: Column) -> Column:
    """The best known length: the stored estimate, else audio tokens, else durations, else a constant per audio."""
    text = F.coalesce(text_tokens(messages), F.lit(0).cast("long"))
    from_tokens = F.when(F.size(tokens) > 0, F.aggregate(tokens, F.lit(0).cast("long"), lambda n, t: n + F.coalesce(t, F.lit(0).cast("long"))))
    summed = F.when(F.size(durations) > 0, F.aggregate(durations, F.lit(0.0), lambda n, d: n + F.coalesce(finite(d), F.lit(0.0))))
    from_seconds = F.floor(summed * AUDIO_RATE).cast("long")
    by_number = (F.coalesce(F.size(audios), F.lit(0)) * UNMEASURED_AUDIO).cast("long")
    return F.coalesce(estimate, text + F.coalesce(from_tokens, from_seconds, by_number))


def padded_cost(lengths: Column, rows: Column | None = None) -> Column:
    """Aggregate: rows times the sum of the largest value of each field."""
    widest = sum((F.max(lengths[f]).cast("long") for f in LENGTH_FIELDS[1:]), F.max(lengths[LENGTH_FIELDS[0]]).cast("long"))
    return (rows if rows is not None else F.count(F.lit(1))) * widest


def duration_error(seconds: Column, role: Column) -> Column:
    """too_short, too_long or not_finite; null (unknown) passes."""
    most = F.when(role == "user", MOST_SECONDS["user"]).otherwise(MOST_SECONDS["assistant"])
    return (
        F.when(F.isnan(seconds) | (F.abs(seconds) == float("inf")), "not_finite").when(seconds < LEAST_SECONDS, "too_short").when(seconds > most, "too_long")
    )


def length_error(
    tokens: Column, durations: Column, assistant_chars: Column, assistant_text: Column, assistant_seconds: Column, padding_limit: int = 500
) -> Column:
    """First broken length rule of a map-style row, in fixed order; null if it is kept.

    With one audio it belongs to the assistant; with several only the first belongs to the user.
    """
    known = F.transform(durations, lambda d, i: duration_error(d, F.when((F.size(durations) > 1) & (i == 0), "user").otherwise("assistant")))
    speech = F.floor(finite(assistant_seconds) * SPEECH_RATE).cast("long")
    audio = F.floor(finite(assistant_seconds) * AUDIO_RATE).cast("long")
    return (
        F.when(tokens > 500, "tokens")
        .when(tokens > padding_limit, "padding")
        .when(F.exists(known, lambda e: e.isNotNull()), "duration")
        .when(assistant_chars > 3000, "assistant_chars")
        .when((assistant_text > 0) & (speech != 0) & (speech < assistant_text), "speech_shorter_than_text")
        .when(tokens + audio > 2000, "total")
    )


def output_rate(codes: Column, features: Column, rate: float = 12.5, most: float = 15.0) -> Column:
    """Codes per feature frame as a rate, clamped; the base rate if undefined, 0 without audio."""
    value = codes / F.greatest(F.lit(1), F.floor(features / 1.33)) * rate
    value = F.coalesce(finite(value), F.lit(rate))
    return F.when(F.coalesce(features, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.0), value)))


def length_vector(user_text: Column, assistant_text: Column, user_audio: Column, assistant_audio: Column, estimate: Column) -> Column:
    """The five length fields; codec tokens lift the total to a stored estimate, never below 0."""
    parts = [F.coalesce(c, F.lit(0)).cast("long") for c in (user_text, assistant_text, user_audio, assistant_audio)]
    known = parts[0] + parts[1] + parts[2] + parts[3]
    codec = F.greatest(F.lit(0).cast("long"), F.coalesce(estimate.cast("long"), F.lit(0).cast("long")) - known)
    return F.struct(*[p.alias(n) for p, n in zip((*parts, codec), LENGTH_FIELDS)])


def rate_embedding(rate: Column, size: int, low: float = 0.0, high: float = 15.0) -> Column:
    """Sines, then cosines, of a clamped and scaled rate at ``size // 2`` falling frequencies."""
    half = size // 2
    x = (F.least(F.greatest(rate, F.lit(low)), F.lit(high)) - low) / max(high - low, 1e-6)
    angle = F.transform(F.sequence(F.lit(0), F.lit(max(half - 1, 0))), lambda k: x * F.pow(F.lit(10000.0), -k / F.lit(float(max(half, 1)))))
    tail = F.array_repeat(F.lit(0.0), size - 2 * half)
    return F.concat(F.transform(angle, F.sin), F.transform(angle, F.cos), tail) if half else tail
