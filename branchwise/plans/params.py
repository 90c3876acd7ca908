"""Parameters pinned per registered query (same values in the oracle SQL)."""

import datetime as _dt

# Fixed values for the registered queries.
AS_OF = _dt.date(2001, 7, 25)        # week 30 of 2001: sales in every branch
AS_OF_WEEK1 = _dt.date(2001, 1, 3)   # week 1: "last week" is always empty
BRANCH = "ASIA"                      # the branch of single-branch reports
TOP_N = 3                            # explicit N of the top-stock report
