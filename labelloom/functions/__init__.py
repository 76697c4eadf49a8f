"""Column expressions: text normalisation, array arithmetic, numeric tails."""
