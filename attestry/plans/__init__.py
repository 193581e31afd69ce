"""Whole workflows as DataFrame plans."""
