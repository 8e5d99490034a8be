"""Column functions: text transforms and named rules."""
