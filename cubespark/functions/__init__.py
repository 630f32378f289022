"""Column functions: scalars, periods, reducers, geometry and coordinate systems."""
