"""Spark-native analytics over R sources: lines, tokens, syntax trees and documentation blocks as tables."""
