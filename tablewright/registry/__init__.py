"""Named queries over the test tables, each with the same question in plain SQL where SQL can ask it."""
