"""DataFrame operators: retrieval, scoring, resolution, sweeps, training pairs, metrics."""
