"""Operators over raw and canonical records."""
