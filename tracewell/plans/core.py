"""The registered queries of the core, and their SQL.

Keys of projections that a problem's queries could be confused with begin with ``ref_``.
"""

from __future__ import annotations

from tracewell.plans import links, nested, pages, texts

QUERIES = {**links.query.queries, **texts.query.queries, **pages.query.queries, **nested.query.queries}
ORACLE = {**links.query.oracle, **texts.query.oracle, **pages.query.oracle, **nested.query.oracle}
