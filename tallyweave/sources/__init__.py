"""Readers and result tables."""
