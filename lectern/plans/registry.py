"""Every registered query by name, with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from . import pages, talk, terms

QUERIES: dict = {**pages.Q, **terms.Q, **talk.Q}
ORACLE_SQL: dict = {**pages.SQL, **terms.SQL, **talk.SQL}
