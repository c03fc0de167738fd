"""Operators over corpora of documents; nothing else in the library imports them."""
