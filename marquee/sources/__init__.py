"""Sources of the marquee catalogue library."""
