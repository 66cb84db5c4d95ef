"""Operators of a training-data pipeline: deduplication, tokenizing, mixing, quality, language, media, chat."""
