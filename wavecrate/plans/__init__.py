"""Reusable shapes of plans: visibility, top-k, band joins, closures, co-occurrence, table merges."""
