"""Which reader a path gets: by its ending, or as told."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import CIRCA_MARGIN
from . import csv, lido
from .records import InputError

FORMATS = {".csv": "csv", ".xml": "lido", ".lido": "lido"}


def detect_format(path) -> str:
    ending = Path(path).suffix.lower()
    if ending not in FORMATS:
        raise InputError([f"{path}: can't tell the format from {ending!r}; it has to be one of {', '.join(FORMATS)}"])
    return FORMATS[ending]


def load_frames(spark: SparkSession, path, input_format: str | None = None, margin: int = CIRCA_MARGIN) -> tuple[DataFrame, DataFrame, str]:
    """(typed records, ingest notes, format); nothing is collected."""
    fmt = input_format or detect_format(path)
    if fmt == "csv":
        return csv.load_records(spark, str(path), margin), spark.createDataFrame([], lido.NOTES), fmt
    if fmt != "lido":
        raise InputError([f"unknown format {fmt!r}"])
    return *lido.load_frames(spark, str(path), margin), fmt


def load_input(spark: SparkSession, path, input_format: str | None = None, margin: int = CIRCA_MARGIN) -> tuple[DataFrame, list[dict], str]:
    """(typed records, ingest notes as a list, format)."""
    records, notes, fmt = load_frames(spark, path, input_format, margin)
    return records, lido.listed_notes(notes) if fmt == "lido" else [], fmt
