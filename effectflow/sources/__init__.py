"""Where facts come from: files, texts, stubs, settings."""
