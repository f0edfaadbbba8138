"""Intermediate tables in the folder that the whole cluster shares, and the proof of what may be broadcast."""

from wavecrate.scratch import BROADCAST_BYTES, cleanup, drop, materialize, scratch_dir, size_bytes, small, tables

__all__ = ["BROADCAST_BYTES", "cleanup", "drop", "materialize", "scratch_dir", "size_bytes", "small", "tables"]
