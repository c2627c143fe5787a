"""Query operators as DataFrame transformations."""
