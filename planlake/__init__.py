"""Spark-native analytics over corpora of nested plan documents."""
