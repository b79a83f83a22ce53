"""Spark-native message-strength analytics and corpus preparation."""
