"""Reading and writing of bars, mappings and reference files."""
