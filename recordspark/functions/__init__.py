"""functions of recordspark."""
