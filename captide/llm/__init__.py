"""Operators for preparing training data from transcripts and documents."""
