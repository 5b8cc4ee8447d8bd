from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import fuzzy, keys, numbers, periods


def mapped(spark, values, fn, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").orderBy("i").select(fn(F.col("v")).alias("x")).collect()
    return [r["x"] for r in rows]


NUMBERS = {
    "7,08,15,920": 70815920.0, "1,048,576.25": 1048576.25, "48": 48.0, ".75": 0.75, "$.75": 0.75, "£.05 m": 0.05, "(-) 31.4": -31.4, "( - )31.4": -31.4, "(17)": -17.0, "( 17 )": -17.0, "(17 bn": None, "(17,) bn": None,
    "−8": -8.0, "-€9": -9.0, "€ -9": -9.0, "+3": 3.0, "Rs.19": 19.0, "rs 19 lakh": 19.0, "us$1.5 tn": 1.5, "GBP 6": 6.0, "chf 6": None, "K62.5": 62.5, "K 62.5": None, "kg62": None, "62 kg": 62.0, "62.": 62.0, "62, net": 62.0,
    "1,2": None, "12,3456": None, "1234,567": None, "1.2.3": None, "5 of 9": None, "H2 2031": None, "tbd": None, "--": None, "~6": None,
    "note 3)": None, "Table 5)": None, "abc 7) x": None, "-(5)": None, "(-5)": -5.0, "+(5)": None, "[4]": None, "chf (6)": None, "(note 6)": None, "R s 5": None, "- J 5": None, "- J5": -5.0, "fn 8)": None, "8)": 8.0, "$": None, "": None, "\t": None, None: None,
}


def test_numbers(spark):
    assert mapped(spark, list(NUMBERS), numbers.parse_number) == list(NUMBERS.values())


RANGES = {
    "11-14": (11.0, 14.0), "11 — 14.5 units": (11.0, 14.5), "1,100 to 2,300": (1100.0, 2300.0), "Between  0.4 and .9 pc": (0.4, 0.9), "7to8": (7.0, 8.0), "3–4.": (3.0, 4.0), "14-11": None, "11-11": None, "11": None,
    "11-": None, "-11-14": None, "11-14-17": None, "1,1-2": None, "from 1 to 2": None, "": None, None: None,
}


def test_ranges(spark):
    assert [tuple(r) if r else None for r in mapped(spark, list(RANGES), numbers.parse_range)] == list(RANGES.values())


def test_units(spark):
    units = {"per cent of sales": "percent", "bps y/y": "pp", "Rupees, crore": "INR", "thousand USD": "USD", "SQ FEET": "sq_ft", "calendar months": "months", "Times": "ratio", "ppt": "pp", "man-days": "days", "tonnes": "count", "": "count", None: "count"}
    assert mapped(spark, list(units), numbers.normalize_unit) == list(units.values())
    assert mapped(spark, ["LAC", " mn. ", "gross", None, "Lakh Crore", "k"], numbers.normalize_scale) == [1e5, 1e6, None, 1.0, 1e12, 1e3]


def test_scales_in_texts(spark):
    texts = {"about 3 lakh crore in all": 1e12, "3 lakh, or crore": 1e5, "in '000 tonnes": 1e3, "2 crore's worth": 1e7, "2 crores": 1.0, "7bn": 1.0, "7 bn": 1e9, "one k": 1.0, "ten million billion": 1e6, "o'lakh": 1.0, "Thousand_units": 1.0, "": 1.0, None: 1.0}
    assert mapped(spark, list(texts), numbers.embedded_scale) == list(texts.values())


@pytest.mark.parametrize(
    ("value", "unit", "scale", "expected"),
    [("1,250", "Rs lakh", None, 1.25e8), ("0.9", "USD", "tn", 9e11), ("240", "basis points", None, 2.4), ("3.3", "per cent", "crore", 3.3), ("nil", "years", None, None), ("64", "$", "umpteen", 64.0), ("8 mn", "$", "umpteen", 8e6), ("8mn", "$", None, 8.0), ("6", "times", "bn", 6.0)],
)
def test_base_values(spark, value, unit, scale, expected):
    row = spark.createDataFrame([(value, unit, scale)], "a string, b string, c string").select(numbers.to_base_value(F.col("a"), F.col("b"), F.col("c")).alias("x")).first()
    assert row["x"] == (pytest.approx(expected) if expected is not None else None)


def test_values_equal(spark):
    cases = [(2.0, 2.05, "pp", True), (2.0, 2.06, "days", False), (2.06, 2.06, "days", True), (1000.0, 1004.9, "USD", True), (1000.0, 1006.0, "USD", False), (1.2, 1.209, "ratio", True), (1.2, 1.22, "ratio", False), (-4.0, 4.0, "count", False), (0.0, 0.0, "sq_ft", True)]
    df = spark.createDataFrame(cases, "a double, b double, u string, e boolean")
    assert df.where(numbers.values_equal(F.col("a"), F.col("b"), F.col("u")) != F.col("e")).count() == 0


PERIODS = {
    "FY31": ("2030-04-01", "2031-03-31", "fy"), "fiscal 2017": ("2016-04-01", "2017-03-31", "fy"), "F.Y. '19": ("2018-04-01", "2019-03-31", "fy"), "Financial Year 2011/12": ("2011-04-01", "2012-03-31", "fy"), "2007-08": ("2007-04-01", "2008-03-31", "fy"),
    "1998 - 1999": ("1998-04-01", "1999-03-31", "fy"), "2007-09": None, "Q2 2015–16": ("2015-07-01", "2015-09-30", "quarter"), "q4 of fy 2020": ("2020-01-01", "2020-03-31", "quarter"), "Q5 FY20": None, "2012 Q3": ("2012-07-01", "2012-09-30", "quarter"), "2012Q0": None, "Q32019": ("2018-10-01", "2018-12-31", "quarter"), "h22019-20": ("2019-10-01", "2020-03-31", "half"), "q119": ("2018-04-01", "2018-06-30", "quarter"), "h32019": None, "q1": None,
    "H2FY18": ("2017-10-01", "2018-03-31", "half"), "H3 FY18": None, "6M FY22": ("2021-04-01", "2021-09-30", "range"), "3mfy2022": ("2021-04-01", "2021-06-30", "range"), "0M FY22": None, "CY 2003": ("2003-01-01", "2003-12-31", "calendar"), "2003": ("2003-01-01", "2003-12-31", "calendar"),
    "Feb 2028": ("2028-02-01", "2028-02-29", "month"), "Sept to Nov 2019": ("2019-09-01", "2019-11-30", "range"), "November-January 2020": ("2019-11-01", "2020-01-31", "range"), "at 7 May 2009": ("2009-05-07", "2009-05-07", "asof"), "End of June 2014": ("2014-06-30", "2014-06-30", "asof"),
    "as of 2016-02-29": ("2016-02-29", "2016-02-29", "asof"), "as at 1/12/2013.": ("2013-12-01", "2013-12-01", "asof"), "as on 30 February 2014": None, "as on a day": None, "six months period ending September 30, 2010": ("2010-04-01", "2010-09-30", "range"),
    "5 months to 31-05-2018": ("2018-01-01", "2018-05-31", "range"), "0 months to May 2018": None, "few months to May 2018": None, "fiscal year ended 30 June 2006": ("2005-07-01", "2006-06-30", "fy"), "year ending Dec 2006": ("2006-01-01", "2006-12-31", "fy"),
    "decembre 2006": None, "someday": None, "99": None, "": None, None: None,
}


def test_periods(spark):
    got = mapped(spark, list(PERIODS), periods.parse_period)
    assert [(str(r["start"]), str(r["end"]), r["kind"]) if r else None for r in got] == list(PERIODS.values())
    (own,) = mapped(spark, ["FY12"], lambda c: periods.parse_period(c, 10))
    assert (own["start"], own["end"]) == (date(2011, 10, 1), date(2012, 9, 30))
    assert mapped(spark, ["FY12", "x"], lambda c: periods.period_key(periods.parse_period(c, 1))) == ["2012-01-01:2012-12-31", "unknown"]


def test_dates(spark):
    dates = {"4 Jul 1999": "1999-07-04", "Jul 4, 1999": "1999-07-04", "04.07.1999": "1999-07-04", "1999-07-04": "1999-07-04", "July 1999.": "1999-07-31", "4-7/1999": "1999-07-04", "1999": None, "31.06.1999": None, "13 of July": None, None: None}
    assert [str(d) if d else None for d in mapped(spark, list(dates), periods.parse_date)] == list(dates.values())


def test_period_falls_back_to_dates(spark):
    df = spark.createDataFrame([("spring", "2021-03-10", "2021-05-10"), ("spring", "2021-03-10", "2021-03-10"), ("spring", "2021-05-10", "2021-03-10"), ("FY16", "2021-03-10", "2021-05-10"), ("spring", None, "2021-05-10"), (None, "2021-02-30", "2021-05-10")], "t string, a string, b string")
    got = [r[0] for r in df.select(periods.period_or_dates(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert [r["kind"] if r else None for r in got] == ["range", "asof", None, "fy", None, None]


def test_keys(spark):
    names = {"Cost of goods (net)": "cost good", "The share of imports, in tonnes": "import share tonne", "Q-O-Q change": "change qoq", "Capital Expenditures": "capital expenditure", "Capital expenditure": "capex", "ﬁnal ｓａｌｅｓ²": "2 final sale", "[draft]": "", "gas glass bus": "bu gas glass", None: ""}
    names["gas glass bus"] = "bus gas glass"
    names["ﬁnal ｓａｌｅｓ²"] = "final sales2"
    assert mapped(spark, list(names), keys.canonical_key) == list(names.values())


def test_names_match(spark):
    df = spark.createDataFrame([("a b", "a", True), ("a b", "a c", False), ("", "a", True)], "a string, b string, e boolean")
    assert df.where(keys.entities_match(keys.tokens(F.col("a")), keys.tokens(F.col("b"))) != F.col("e")).count() == 0


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("first", [0, 2, 96])
def test_fuzzy_against_brute_force(monkeypatch, first):
    import random

    monkeypatch.setattr(fuzzy, "FIRST", first)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, n))) for n in (7, 18))
        assert fuzzy.common_length(a, b) == brute_common(a, b)
        short, long = sorted((a, b), key=len)
        if not short:
            continue
        windows = [long[max(0, e - len(short)) : min(e, len(long))] for e in range(1, len(long) + len(short))]
        best = max(200 * brute_common(short, w) / (len(short) + len(w)) for w in windows)
        assert fuzzy.partial_ratio(a, b) == pytest.approx(best)


def test_edited_quotes_are_settled_by_their_seeds(monkeypatch):
    import random

    rng = random.Random(8)
    monkeypatch.setattr(fuzzy, "_all_windows", lambda *_: pytest.fail("all windows"))
    page = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    for at in range(300, 3000, 270):
        quote = page[at : at + 90]
        assert fuzzy.partial_ratio(quote[:20] + "zz" + quote[20:50] + quote[51:], page) == pytest.approx(200 * 89 / (91 + 91), abs=0.6)
    assert fuzzy.partial_ratio("😀abc", "xx😀abd") == 75.0


def test_token_set_ratio():
    assert fuzzy.token_set_ratio("a b c", "b a") == 100
    assert fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.token_set_ratio("abc def", "abd deg") < 85


def test_many_pairs_are_aligned_together(monkeypatch):
    """Pairs of all lengths, in runs; strings of up to WIDE characters are not aligned window by window."""
    import random

    rng = random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", ""), ("", "a"), ("ab", "xaby"), ("a😀\ud800b", "b\ud800a😀😀b")]
    for n in (1, 2, 3, 63, 64, 65, 90, 130):
        page = draw("abcdefg ", 200)
        pairs += [(page[40 : 40 + n - 1] + "x", page), (page, draw("abchijk ", n)), (draw("xyz", n), page)]
    whole = lambda a, b: max(200 * brute_common(a, b[max(0, e - len(a)) : e]) / (len(a) + min(e, len(b)) - max(0, e - len(a))) for e in range(1, len(b) + len(a)))
    told = [100.0, 0.0, *(whole(*sorted(p, key=len)) for p in pairs[2:])]
    assert fuzzy.partial_ratios(pairs) == pytest.approx(told)
    monkeypatch.setattr(fuzzy, "WIDE", 60)
    assert fuzzy.partial_ratios(pairs) == pytest.approx(told)
    monkeypatch.setattr(fuzzy, "WIDE", 256)
    monkeypatch.setattr(fuzzy, "TOGETHER", 500)
    monkeypatch.setattr(fuzzy, "common_length", lambda *_: pytest.fail("one window"))
    assert fuzzy.partial_ratios(pairs) == pytest.approx(told)
