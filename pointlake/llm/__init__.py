"""Operators for training data: vectors, clusters, time matching, tokens, leakage and sentences."""
