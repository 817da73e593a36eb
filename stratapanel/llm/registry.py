"""Queries of the text operators and the SQL that some of them must equal."""

from stratapanel.llm import exact_dedup, language, licenses, line_dedup, media, minhash, mixing, packing, ranked_search, simhash, suffix_dedup, token_counts, token_links

_MODULES = [mixing, language, suffix_dedup, media, token_counts, exact_dedup, packing, licenses, line_dedup, simhash, token_links, ranked_search, minhash]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
