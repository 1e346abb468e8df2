"""Keyed state over batches and streams."""
