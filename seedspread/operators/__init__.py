"""DataFrame -> DataFrame operators (sampling, kNN, graph, propagation, prediction, metrics, sweeps)."""
