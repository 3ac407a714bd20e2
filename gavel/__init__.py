"""Spark-native analytics over legislative records: browse, geo, flags, ingestion."""
