"""Column functions: spatial keys, cameras, colours, splines."""
