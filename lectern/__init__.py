"""Lectern: a Spark-native document-corpus analytics engine."""
