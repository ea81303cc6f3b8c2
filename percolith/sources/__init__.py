"""Readers and writers of projects, node and edge tables, structures, and result bundles."""
