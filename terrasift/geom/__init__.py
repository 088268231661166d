"""Geometry kernel in numpy: WKB, measures, validity, repair, relations, coordinate systems."""
