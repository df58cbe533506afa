"""Readers and writers of volumes, manifests, vectors, datasets and hits."""
