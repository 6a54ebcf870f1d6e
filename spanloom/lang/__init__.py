"""The pattern language: syntax tree and parser."""
