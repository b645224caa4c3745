"""Parameters the registered queries run with (fixed so results are testable).

The analyses read ``current_date``; every job takes an explicit ``as_of``
instead. The risk cut's own dates lie outside the test data, so the
registered query runs it over calendar 1999.
"""

import datetime as dt

AS_OF = dt.date(1999, 6, 16)
RISK_START = dt.date(1999, 1, 1)
RISK_END = dt.date(1999, 12, 31)
DISPUTE_WIN = 7
TOP_CASES = 10
TOP_MCC = 9
TOP_MERCHANT = 20
TOP_STATE = 9
# Accounts of the selective history pull: members with an id below this.
SUBSET_BELOW = 150
# Ranks kept by the label_top_n query: fewer than there are groups, so that some fall out.
LABEL_TOP = 3
# Buckets of the stored facts (sources/bucketed.py): the test data's size, not a cluster's.
BUCKETS = 16


def wow_window(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Report window for a run on ``as_of``: four complete weeks.

    day1 = Monday of the week holding (as_of - 35 d);
    day2 = (Monday of the week holding as_of - 7 d) - 1 d, a Sunday.
    """
    def monday(d: dt.date) -> dt.date:
        return d - dt.timedelta(days=d.weekday())

    day1 = monday(as_of - dt.timedelta(days=35))
    day2 = monday(as_of - dt.timedelta(days=7)) - dt.timedelta(days=1)
    return day1, day2
