"""Strings with the readings they must have: inputs and expected rows of the scalar operators."""

VALUES = [
    ("₹3,415 Cr", "money", 3.415e10, "INR"), ("₹96Cr", "money", 9.6e8, "INR"), ("€75,250.50 million", "money", 7.52505e10, "EUR"), ("Rs. 219 lakh", "money", 2.19e7, "INR"), ("US$ 3.5 bn", "money", 3.5e9, "USD"),
    ("£2.25 trillion", "money", 2.25e12, "GBP"), ("₹2.5 lakh crore", "money", 2.5e12, "INR"), ("7.25 per cent", "percent", 7.25, "%"), ("0.4%", "percent", 0.4, "%"), ("125 bps", "points", 1.25, "pp"),
    ("2 percentage points", "points", 2.0, "pp"), ("96,301", "number", 96301.0, None), ("2.5 Mn Tonnes", "quantity", 2.5e6, "tons"), ("615 Mn", "number", 6.15e8, None), ("14 days", "quantity", 14.0, "days"),
    ("3.5 Bn parcels", "quantity", 3.5e9, "parcels"), ("to be announced", "text", None, None), ("₹(87) Cr", "money", -8.7e8, "INR"), ("Rs. (64 Cr)", "money", -6.4e8, "INR"), ("(2.9%)", "percent", -2.9, "%"),
    ("(4,120)", "number", -4120.0, None), ("-1.7%", "percent", -1.7, "%"), ("１２ Cr", "number", 1.2e8, None), ("５％", "percent", 5.0, "%"), ("（３９）", "number", -39.0, None), ("￡７", "money", 7.0, "GBP"),
]
PERIODS = [
    ("FY19", "2018-04-01", "2019-03-31", "year"), ("FY 2016-17", "2016-04-01", "2017-03-31", "year"), ("2011-12", "2011-04-01", "2012-03-31", "year"), ("FY2009/10", "2009-04-01", "2010-03-31", "year"),
    ("2007/08", "2007-04-01", "2008-03-31", "year"), ("1999-00", "1999-04-01", "2000-03-31", "year"), ("Q2 FY18", "2017-07-01", "2017-09-30", "quarter"), ("Q4 FY15", "2015-01-01", "2015-03-31", "quarter"),
    ("H2 FY20", "2019-10-01", "2020-03-31", "half"), ("9M FY13", "2012-04-01", "2012-12-31", "nine_month"), ("CY2017", "2017-01-01", "2017-12-31", "year"), ("August 2012", "2012-08-01", "2012-08-31", "month"),
    ("as of June 30, 2018", "2018-06-30", "2018-06-30", "instant"), ("as at 15 November 2016", "2016-11-15", "2016-11-15", "instant"), ("FY2014", "2013-04-01", "2014-03-31", "year"), ("1998", "1998-01-01", "1998-12-31", "year"),
    ("30 February 2011", None, None, None), ("2003-2009", None, None, None), ("page 31-33", None, None, None), ("table 7-9", None, None, None), ("41-43 per cent", None, None, None), ("Rs. 20-25 lakh", None, None, None),
    ("standalone", None, None, None), ("", None, None, None),
]


def sql(rows: list[tuple], names: list[str]) -> str:
    """A relation of the rows as SQL text."""
    one = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"cast({x!r} AS double)"
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"
