"""Readers and writers: line-aligned text, wide TSV, topic-model tables, the text index."""
