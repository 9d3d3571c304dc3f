"""All queries outside the llm subpackage."""

from __future__ import annotations

from colloquy.plans import core, reference

FLAGSHIP = "chunk_ids"
QUERIES = {**core.QUERIES, **reference.QUERIES}
SQL = {**core.SQL, **reference.SQL}
