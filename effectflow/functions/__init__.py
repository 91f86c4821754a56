"""Column functions over names, paths, messages."""
