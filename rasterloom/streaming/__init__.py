"""Operators over streams of frames."""
