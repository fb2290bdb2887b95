"""Composed plans: the journey stages wired together, the query catalog
behind ``__spark_entry__`` and the oracle SQL texts."""
