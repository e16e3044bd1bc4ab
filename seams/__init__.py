"""Spark-native ranking of component pairs, with training-data operators in seams.llm."""
