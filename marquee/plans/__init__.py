"""Plans of the marquee catalogue library."""
