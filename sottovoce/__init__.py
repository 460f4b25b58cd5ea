"""Spark-native disclosure-risk analytics: text scoring, stream state, audit and reporting."""
