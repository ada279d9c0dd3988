"""Search, statistics and contamination operators over corpora (uid, text) and needles (query_id, query)."""
