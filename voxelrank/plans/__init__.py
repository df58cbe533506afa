"""Plan generators: slices, patches, windows, views, crops."""
