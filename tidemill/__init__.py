"""Spark-native analytics over agent event logs and prompt/completion corpora."""
