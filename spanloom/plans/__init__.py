"""Named queries of the pattern engine and their SQL."""
