"""DataFrame operators: joins, dedup, splits, sampling, statistics and models."""
