"""Retrieval, chunking, metric and statistics operators."""
