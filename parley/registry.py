"""All queries over the engine's own operators, with their SQL twins."""

from __future__ import annotations

from parley.plans import analysis, board, chats, cleaning, display, english, entities, kinds, phrases, review, similarity, snippets, stats, words

MODULES = (words, chats, cleaning, display, english, entities, kinds, phrases, similarity, snippets, stats, board, analysis, review)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
