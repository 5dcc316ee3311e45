"""Column expressions over the frames of a series."""
