"""Incremental, resumable evaluation."""
