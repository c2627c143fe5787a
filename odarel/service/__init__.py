"""The engine: requests, pages, tokens, batches, hooks."""
