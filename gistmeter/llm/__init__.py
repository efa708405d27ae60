"""Operators of a training-data pipeline over document, label, benchmark and conversation tables."""
