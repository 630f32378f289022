"""Operators on cubes; the fluent methods of ``DataCube`` call them."""
