"""Streams. The dialect has none; these are extensions for event tables."""
