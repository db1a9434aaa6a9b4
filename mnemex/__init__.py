"""PySpark-native analytics for agent-memory data and training-data corpora."""
