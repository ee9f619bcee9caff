"""Conversation analytics on Spark DataFrames: segments, turns, personal data and training text."""
