"""The batch operators that also make sense on an unbounded table."""
