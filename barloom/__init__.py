"""Spark-first factor analytics: bars, panels, formulas, scoring and back-tests as DataFrame plans."""
