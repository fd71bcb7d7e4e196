"""plans of recordspark."""
