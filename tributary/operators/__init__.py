"""Set-oriented operators: merge, confidence, validation, projection, lookups."""
