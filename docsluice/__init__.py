"""Sorting of document tables and streams into business categories at a controlled cost."""
