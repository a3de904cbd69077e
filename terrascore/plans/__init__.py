"""Whole jobs: indicators, reference sheets, serving queries, driver checks."""
