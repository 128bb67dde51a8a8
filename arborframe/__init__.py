"""Spark-native analytics over spatial graphs, rooted trees and annotations."""
