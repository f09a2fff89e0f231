"""Operators for preparing training text: quality, mixing, privacy, URLs, tokens, media, languages, search, near copies."""
