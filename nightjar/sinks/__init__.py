"""Sinks: batch results, error sheets, previews, evaluation outputs, JSON documents."""

from nightjar.sinks.export import (
    EXPORT_PARTS, save_evaluation_outputs, write_batch_csv, write_batch_export, write_result_json,
)

__all__ = ["EXPORT_PARTS", "save_evaluation_outputs", "write_batch_csv", "write_batch_export",
           "write_result_json"]
