"""Corpora: schema configuration, readers, stored corpora, views and test adapters."""
