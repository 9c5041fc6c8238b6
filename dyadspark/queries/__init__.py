"""The registered queries: one per operator, each with its check in plain SQL where SQL can express it."""
