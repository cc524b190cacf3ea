"""Training-data operators over whole corpora. Nothing else in the library imports this subpackage."""
