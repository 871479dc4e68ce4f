"""Language specifications and the parser that they drive."""
