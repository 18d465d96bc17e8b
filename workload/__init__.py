"""The queries checked and timed on the given star-schema tables."""
