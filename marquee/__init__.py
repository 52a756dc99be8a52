"""marquee: film and TV catalogue import, pages, listings and analyses as Spark jobs."""
