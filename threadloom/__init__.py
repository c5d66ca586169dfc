"""Conversation retrieval and analytics on Spark DataFrames."""
