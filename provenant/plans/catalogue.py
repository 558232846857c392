"""The queries over the driver's tables, by name, and the same in SQL."""

from provenant.plans import checks, histories, pages, records, runs, stored, web

QUERIES = runs.QUERIES | records.QUERIES | pages.QUERIES | histories.QUERIES | checks.QUERIES | web.QUERIES | stored.QUERIES
SQL = runs.SQL | records.SQL | pages.SQL | histories.SQL | checks.SQL | web.SQL | stored.SQL
