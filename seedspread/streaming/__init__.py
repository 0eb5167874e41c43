"""Structured Streaming learner: foreachBatch over versioned Parquet state."""
