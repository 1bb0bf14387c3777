"""Tables on disk, one file set per table and site, and synthetic tables."""
