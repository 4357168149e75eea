"""Exports: JSON, Lua modules, the search page, extracted files, mod skeletons."""
