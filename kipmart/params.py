"""Parameters of the registered queries (the reference's request parameters).

Reports that take "now" get ``AS_OF`` explicitly so runs are deterministic.
"""

import datetime as _dt

MONTH = "1998-03"          # ?month= for summary, profit, status, daily, preorder day
DAY = "1996-07-04"         # ?date= for day_orders
YEAR = 1998                # ?year= for preorder week / month
AS_OF = _dt.datetime(2001, 8, 2, 12, 0, 0)   # "now" for reports and OTP checks
SEARCH = "sMall"           # ?search= for the catalogue
CATEGORY = 13              # ?category= for the catalogue
STATUS = "pending"         # ?status= for the admin order list
LOW_STOCK = 5              # low-stock threshold
