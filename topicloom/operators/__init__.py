"""Operators over corpora, topic assignments and topic models."""
