"""Spark-native analytics over agent memory: events, facts, conversations and documents."""
