"""DataFrame operators: ranks, folds, encodings, windows, metrics, blends."""
