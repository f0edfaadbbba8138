"""Column functions: text, music, time."""
