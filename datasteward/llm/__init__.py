"""Operators for preparing training text: formatting, near duplicates, language, pieces, search, shards, mixing,
quality, personal data and token counts. Nothing outside this package imports it."""
