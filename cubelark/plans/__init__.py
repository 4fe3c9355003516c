"""Requests, their validation, and plans: a DataFrame for each node of the graph of operations."""
