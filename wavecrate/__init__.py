"""Music-catalog analytics as pure DataFrame operators on PySpark."""
