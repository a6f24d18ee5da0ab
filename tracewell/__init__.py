"""Spark-native analytics for messages, links, web captures and labels."""
