"""Solvers, path plans, cross-validation, diagnostics and estimators."""
