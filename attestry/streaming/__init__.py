"""Drafts as a stream."""
