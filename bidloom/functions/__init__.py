"""Column functions over whole tables."""
