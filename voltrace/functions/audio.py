"""Audio quality from media tool logs: levels, clipping and silence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tool's log lines and the limits of the quality reasons.
PEAK, RMS = r"Peak level dB:\s*(-?inf|-?\d+\.?\d*)", r"RMS level dB:\s*(-?inf|-?\d+\.?\d*)"
PEAK_COUNT, SAMPLES = r"Peak count:\s*(\d+)", r"Number of samples:\s*(\d+)"
SILENCE = r"silence_duration:\s*(\d+\.?\d*)"
CLIP_DBFS, HIGH_CLIP, MOSTLY_SILENT = -0.1, 0.001, 0.5


def _all(log: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(pattern), F.lit(1))


def _last(log: Column, pattern: str) -> Column:
    """The last match, the overall value behind those of the channels, as a number; NULL for none or -inf."""
    values = _all(log, pattern)
    return F.try_element_at(values, F.lit(-1)).try_cast("double")


def parse_log(log: Column, seconds: Column) -> Column:
    """struct<peak_dbfs, rms_dbfs, clip_ratio, silence_ratio>: clipping counts only where the peak is near full scale; both
    ratios are at most 1; silence is the summed silent stretches over the duration."""
    peak = _last(log, PEAK)
    peak = F.when(F.isnan(peak) | (peak == F.lit(float("-inf"))), F.lit(None)).otherwise(peak)
    rms = _last(log, RMS)
    rms = F.when(F.isnan(rms) | (rms == F.lit(float("-inf"))), F.lit(None)).otherwise(rms)
    clip = F.when(peak >= CLIP_DBFS, F.try_divide(_last(log, PEAK_COUNT), F.nullif(_last(log, SAMPLES), F.lit(0.0))))
    silent = F.aggregate(_all(log, SILENCE), F.lit(0.0), lambda a, x: a + x.cast("double"))
    share = F.when(seconds > 0, silent / seconds).otherwise(0.0)
    return F.struct(
        peak.alias("peak_dbfs"), rms.alias("rms_dbfs"), F.least(F.coalesce(clip, F.lit(0.0)), F.lit(1.0)).alias("clip_ratio"), F.least(share, F.lit(1.0)).alias("silence_ratio")
    )


def quality_reason(decoded: Column, clip: Column, silence: Column) -> Column:
    """decode_error, then high_clipping, then mostly_silent, else empty."""
    return F.when(~F.coalesce(decoded, F.lit(False)), "decode_error").when(clip > HIGH_CLIP, "high_clipping").when(silence > MOSTLY_SILENT, "mostly_silent").otherwise("")


def window_count(seconds: Column, window: float = 30.0, least: float = 1.0) -> Column:
    """Windows of fixed length over a recording; a tail shorter than ``least`` seconds has none."""
    whole = F.floor(seconds / window)
    tail = seconds - whole * window
    return F.when(seconds > 0, whole + F.when(tail >= least, 1).otherwise(0)).otherwise(0).cast("long")
