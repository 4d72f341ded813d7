"""Spark jobs for training-corpus preparation, rollout scoring and run analytics."""
