"""The same work on files as they arrive."""
