"""Card-dispute and fraud-review analytics as Spark DataFrame jobs.

Layout:
    sources/    driver tables and the 25 warehouse-shaped relations derived from them
    functions/  column helpers: dialect semantics, bucket and code mappings
    operators/  keep-first dedup, interval / either-key / any-party joins, top-n labels
    plans/      the user-level jobs (risk cut, weekly top cases, account history,
                week-over-week dispute report) and the query registry
    oracle/     DuckDB SQL for every registered query (correctness oracle)
    streaming/  nothing: every job is a one-shot batch query
"""

from disputelens.session import build_session, ensure_checkpoint_dir  # noqa: F401
