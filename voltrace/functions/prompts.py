"""Names of files and prompts for rating models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_slug(model: Column) -> Column:
    """A model's name as part of a file name: ``org/name:tag`` becomes ``org__name_tag``."""
    return F.replace(F.replace(model, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


def recording_path(source: str, year: Column, recording: Column) -> Column:
    """Where a call's recording lies below the data folder."""
    return F.concat(F.lit(f"raw/{source}/mp3_"), year.cast("string"), F.lit("/"), recording.cast("string"), F.lit(".mp3"))


def call_folder(day: Column, ticker: Column) -> Column:
    """YYYYMMDD_TICKER."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), ticker)


def section_prompt(section: Column, text: Column, anchors: dict[str, dict[str, str]]) -> Column:
    """The question for one section: its name, a line for each field that applies to it, then the whole text."""
    lines: Column = F.lit("")
    for name, fields in anchors.items():
        lines = F.when(section == name, F.lit("\n".join(f"- {f}: {said}" for f, said in fields.items()))).otherwise(lines)
    return F.concat(F.lit("Section: "), section, F.lit("\n"), lines, F.lit("\n\nText:\n"), text)


def context_extension(longest: int, native: int) -> dict:
    """Settings that stretch a model's context from ``native`` to ``longest`` positions, so that no section is cut."""
    if longest <= native:
        raise ValueError(f"{longest} positions fit into {native} already")
    return {"rope_type": "yarn", "factor": longest / native, "original_max_position_embeddings": native}
