"""sources of recordspark."""
