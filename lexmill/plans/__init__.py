"""Ready-made queries over the standard tables, each with the same question in SQL where SQL can ask it."""
