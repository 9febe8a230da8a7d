"""Spark-native analytics for tables and streams of AI-agent security events."""
