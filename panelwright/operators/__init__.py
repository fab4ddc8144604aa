"""Panel transforms, per-unit regressions, estimators and tests."""
