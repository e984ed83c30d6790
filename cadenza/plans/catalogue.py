"""All queries of the core, with their SQL."""

from cadenza.plans import alignment, coverage, decoding, evaluation, extras, goldens, intervals, language, likeness, signals

_MODULES = [coverage, intervals, evaluation, signals, likeness, alignment, language, decoding, extras, goldens]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
