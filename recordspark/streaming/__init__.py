"""streaming of recordspark."""
