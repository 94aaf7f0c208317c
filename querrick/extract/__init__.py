"""From file texts to rows of files, symbols, chunks and references."""
