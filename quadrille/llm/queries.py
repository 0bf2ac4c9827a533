"""The registered corpus queries and the SQL that some are compared with."""

from . import (
    decontamination,
    fingerprints,
    html_text,
    language_id,
    mixing,
    near_dedup,
    quality,
    substring_dedup,
    token_output,
    url_filter,
)

_MODULES = (
    language_id,
    fingerprints,
    url_filter,
    quality,
    decontamination,
    mixing,
    token_output,
    html_text,
    near_dedup,
    substring_dedup,
)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
