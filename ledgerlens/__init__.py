"""Spark-native screening of ownership-history event chains."""
