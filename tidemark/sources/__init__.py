"""Raw scans, work-lists and stored tables."""
