"""DataFrame operators over lines, files, events, documents and service tables."""
