"""Column expressions: numbers, sequences, pairing vectors and labels."""
