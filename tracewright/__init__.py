"""Spark-native triage of delimited logs, and training-data operators in ``tracewright.llm``."""
