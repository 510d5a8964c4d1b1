"""Operators of a training-data pipeline: tokens, search, chat, mixing, extraction, language, media, duplicates and quality."""
