"""Readers and writers of samples, matrices, metadata and artefacts."""
