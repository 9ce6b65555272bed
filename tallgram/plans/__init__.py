"""Parameter sweeps and the tables derived from their results."""
