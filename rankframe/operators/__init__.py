"""Operators: functions from DataFrames to DataFrames, mostly ``ranked(query_id, doc_id, rank, score)``."""
