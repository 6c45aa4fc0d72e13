"""Readers of posts, gazetteers and geometries, and writers of the archive."""
