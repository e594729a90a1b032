"""Declared columns of the catalogue tables; every raw field is text and the empty string means missing."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the file formats.
PASSAGES = ("passage_id", "composer", "work_title", "movement", "relative_path", "start_bar", "end_bar", "key", "meter")
PASSAGE_EXTRAS = ("composition_id", "work_id", "score_version_id", "performance_id", "recording_id", "alignment_id", "audio_origin", "source_dataset", "license")
CORPUS = (
    "passage_id", "composer", "period", "work_id", "movement_id", "recording_id", "score_path", "mxl_path", "audio_path", "midi_path", "alignment_path",
    "annotation_path", "bar_start", "bar_end", "score_format", "alignment_format", "rights_status", "segment_type", "annotation_type", "fully_aligned",
    "availability_status",
)
PROMPTS = ("prompt_id", "family", "subfamily", "prompt_text", "polarity", "composer_reference", "interpretive_level", "enabled", "notes")
ALIGNMENT_EVENTS = (
    "recording_id", "movement_id", "alignment_id", "score_measure", "score_measure_label", "onset_seconds", "offset_seconds", "confidence", "granularity",
    "method", "quality_label",
)
#: Columns that may not change within one recording.
STABLE = ("composer", "work_id", "movement_id", "score_path", "audio_path", "midi_path")


def text_columns(names: tuple[str, ...]) -> T.StructType:
    """All columns as strings."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
