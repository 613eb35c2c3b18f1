"""Spark jobs that check document corpora: extract, route, score, roll up, align, measure."""

__version__ = "0.1.0"
