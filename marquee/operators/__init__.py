"""Operators of the marquee catalogue library."""
