"""Sources of documents."""
