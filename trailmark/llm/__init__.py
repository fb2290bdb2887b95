"""Operators of a training-data pipeline: extraction, archives, language,
toxicity, licences, near-duplicates, nearest neighbours, mixing and packing."""
