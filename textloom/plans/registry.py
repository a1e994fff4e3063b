"""Where queries register themselves, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: DuckDB: tokens t(doc_id, pos, term) as operators.tokens.tokens() gives them.
TOKENS = "t as (select doc_id, i - 1 as pos, w[i] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(lower(text), '[A-Za-z]+') as w from documents)))"
CASED = "t as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as term from documents)"
