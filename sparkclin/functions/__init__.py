"""Column functions: text normalisation, dates of partial precision, units."""
