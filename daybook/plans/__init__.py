"""Registered queries over the given tables, each with the SQL that checks it where SQL can say it."""

from . import archive_plans, calendar_plans, evaluation_plans, filter_plans, search_plans, text_plans

MODULES = (archive_plans, text_plans, search_plans, filter_plans, calendar_plans, evaluation_plans)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}
