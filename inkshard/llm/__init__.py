"""Training-data operators over rendered documents ``(doc_id, text)``; nothing else in the library imports them."""
