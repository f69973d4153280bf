"""Column functions: text, URLs, vectors and normalisers of model output."""
