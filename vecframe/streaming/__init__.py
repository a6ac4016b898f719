"""Collections fed and searched by streams."""
