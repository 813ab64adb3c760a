"""Operators of a training-data pipeline: tokens, duplicates, pages, models, media, secrets, packing."""
