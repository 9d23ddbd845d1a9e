"""DataFrame operators: profile, ranks, splits, preparation, metrics, statistics."""
