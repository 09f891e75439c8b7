"""The stages of a run, and the queries over the benchmark tables."""
