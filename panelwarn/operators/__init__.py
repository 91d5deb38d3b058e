"""DataFrame operators: panel joins, features, profiling, sampling, metrics, models, scoring."""
