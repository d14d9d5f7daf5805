"""Column functions: text shaping, chat transcripts, answer parsing, vectors."""
