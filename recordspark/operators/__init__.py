"""operators of recordspark."""
