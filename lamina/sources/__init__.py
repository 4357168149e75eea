"""Readers and writers: archives, node trees, definition text, recipes and localization."""
