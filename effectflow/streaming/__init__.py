"""Edit streams: debounced runs, folded texts, caches with a time to live."""
