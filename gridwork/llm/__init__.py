"""Operators of a training-data pipeline: near-duplicates, exact search, token
files, tokenization, mixing, chat formatting, toxicity, language and personal
data. Nothing else in the library imports this subpackage."""
