"""Functions of the marquee catalogue library."""
