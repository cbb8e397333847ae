"""Spark-native engine for building, answering and scoring pick-one-of-K decision data."""
