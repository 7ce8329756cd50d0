"""Pixel tables from arrays, grids, functions of the place, image files and other tables."""
