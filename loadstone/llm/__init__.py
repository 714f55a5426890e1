"""Operators for language data: names, matching, token ids, packing and sentence units."""
