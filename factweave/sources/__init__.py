"""Readers, writers and the two Python boundaries (document parser, fact extractor)."""
