"""Operators of a training-data pipeline: de-duplication, scoring, scanning, mixing."""
