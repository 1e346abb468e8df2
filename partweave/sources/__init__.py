"""Readers of stored records and the stores they form."""
