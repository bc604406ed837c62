"""Operators of a training-data pipeline: tokens, secrets, chat layouts, duplicates, packing, language, quality, search."""
