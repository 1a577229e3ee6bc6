"""Operators for preparing text for training: cleaning, deduplication, filtering and encoding at corpus scale."""
