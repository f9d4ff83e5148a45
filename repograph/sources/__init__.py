"""Readers and writers: repository folders, tool reports, wiki and chunk stores, documents."""
