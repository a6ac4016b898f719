"""Where collections are kept and read from."""
