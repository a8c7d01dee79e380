"""Column functions: text, numbers, addresses, hashes, extraction."""
