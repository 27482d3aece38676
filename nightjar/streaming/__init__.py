"""Structured Streaming: the row-local flow and the table-level report on an unbounded night source."""

from nightjar.streaming.reports import read_reports, start_report_stream
from nightjar.streaming.rowlocal import score_stream, start_scoring_stream

__all__ = ["read_reports", "score_stream", "start_report_stream", "start_scoring_stream"]
