"""Embedding retrieval over sliced volumes, as composable DataFrame operators."""
