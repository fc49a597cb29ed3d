"""Additive estimators over streams (an extension)."""
