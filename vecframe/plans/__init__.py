"""The query dialect of one collection."""
