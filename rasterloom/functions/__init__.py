"""Column functions over small values: channel scalars, vectors, points, sizes, rectangles."""
