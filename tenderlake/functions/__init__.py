"""Column expressions: key normalisation, money, dates and text."""
