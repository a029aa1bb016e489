"""Reading and writing frames, hierarchies and level tables."""
