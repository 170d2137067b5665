"""Spark-native capture analytics: typed records, merges, joins and state over landed snapshots."""
