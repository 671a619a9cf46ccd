"""Operators of a training-data pipeline over a corpus table (doc_id, text, lang, source, n_chars)."""
