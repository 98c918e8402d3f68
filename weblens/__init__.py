"""Spark-native web-page audit, site-graph analytics and corpus preparation."""
