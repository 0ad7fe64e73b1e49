"""Readers and writers of molecule text, tables and manifests."""
