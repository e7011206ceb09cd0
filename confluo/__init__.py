"""Replicated-data analytics on Spark: op logs, converged state, diffs, sync and retention."""
