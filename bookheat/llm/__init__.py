"""Training-data operators: classifiers, tokens, secrets, duplicates, vectors, archives, mixing."""
