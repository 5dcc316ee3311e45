"""Operators on series: each takes (df, spec, ...) and returns df with named columns added, or one row per series."""
