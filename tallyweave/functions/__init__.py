"""Column builders: scalars and estimators."""
