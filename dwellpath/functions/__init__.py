"""Part of dwellpath."""
