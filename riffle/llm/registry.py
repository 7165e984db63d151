"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from riffle.llm import ann, audio, audit, bpe, licences, lines, mixing, quality, sharding, simhash, topk, whitening

MODULES = [simhash, lines, mixing, sharding, bpe, quality, audio, licences, ann, audit, topk, whitening]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
