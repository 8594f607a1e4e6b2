"""Column functions and the ordered fold shared by the operators."""
