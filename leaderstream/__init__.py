"""Streaming leaderboards over JSON statistic events, as DataFrame operators."""

from leaderstream.board import Board
from leaderstream.metrics import METRICS, Metric

__all__ = ["METRICS", "Board", "Metric"]
