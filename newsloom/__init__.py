"""Spark-native news, sports and text-corpus analytics."""
