import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.functions import normalize as nz, similarity as sim


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).collect()[0])


def test_names(spark):
    n = lambda s: one(spark, nz.norm_name(F.lit(s)), nz.name_core(F.lit(s)))
    assert n("The Acme (U.K.) Ltd.") == ("ACME U K LIMITED", "ACME U K")
    assert n(" The Acme") == ("THE ACME", "THE ACME")  # the article goes only at the very start
    assert n("Smith & Co LIMTED") == ("SMITH AND COMPANY LIMTED", "SMITH AND COMPANY")
    assert n("X Holdings Plc") == ("X HOLDINGS PLC", "X HOLDINGS")
    assert n("Straße GmbH") == ("STRA E GMBH", "STRA E")
    assert one(spark, nz.norm_name(F.lit(None)), nz.norm_postcode(F.lit(" wa14 2dt ")),
               nz.norm_postcode(F.lit(" - "))) == ("", "WA142DT", None)


def test_sql_functions(spark):
    nz.register_sql(spark)
    row = spark.sql("select norm_name('The Acme & Co Ltd'), name_core('Acme GmbH'), norm_postcode('a1 b2')").collect()
    assert tuple(row[0]) == ("ACME AND COMPANY LIMITED", "ACME", "A1B2")


def test_sql_functions_equal_the_columns(spark):
    nz.register_sql(spark)
    odd = ["a\u00df1", "Stra\u00dfe GmbH & Co", "The \ufb01rm's Ltd", None, "  ", "X\\Y 'quoted' LIMTED", "\u00a0wa1\t"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for r in df.selectExpr("x", "norm_name(x) a", "name_core(x) b", "norm_postcode(x) c").collect():
        assert (r.a, r.b, r.c) == one(spark, nz.norm_name(F.lit(r.x)), nz.name_core(F.lit(r.x)),
                                      nz.norm_postcode(F.lit(r.x)))


def test_white_space_dates_and_large_totals(spark):
    assert one(spark, nz.strip(F.lit("\u00a0\t a b\u3000\n")), nz.company_number_input(F.lit("\t77\u00a0")),
               nz.regno(F.lit("\u00a0sc1\t"))) == ("a b", "00000077", "SC1")
    d = one(spark, *[nz.day_month_year(F.lit(x)) for x in ("1/2/2020", "01/02/2020", "31/2/2020", "1/13/2020")])
    assert [x and x.isoformat() for x in d] == ["2020-02-01", "2020-02-01", None, None]
    rows = spark.range(4).select(nz.units(F.lit(8e14), nz.MONEY).alias("u"))
    assert rows.agg(nz.total_units(F.col("u")).alias("s")).first().s == 4 * 8 * 10**18


def test_numbers_and_dates(spark):
    assert one(spark, nz.regno(F.lit("1234")), nz.regno(F.lit(" sc12 ")), nz.regno(F.lit(" ")),
               nz.regno(F.lit("123456789"))) == ("00001234", "SC12", None, "12345678")
    assert one(spark, nz.company_number_input(F.lit(" 77 ")), nz.company_number_input(F.lit("sc1"))) == (
        "00000077", "SC1")
    d = one(spark, nz.day_mon_yy(F.lit("14-MAR-26")), nz.day_mon_yy(F.lit("01-JAN-69")),
            nz.day_mon_yy(F.lit("01-JAN-68")), nz.day_month_year(F.lit("31/02/2020")), nz.day_month_year(F.lit("")))
    assert [x and x.year for x in d] == [2026, 1969, 2068, None, None]
    assert one(spark, nz.fx_rate(F.lit("JPY")), nz.fx_rate(F.lit("USD")), nz.severity(F.lit("Pink"))) == (None, 0.78, 0.0)
    assert one(spark, nz.regime_subject(F.lit("The Russia (Sanctions) (EU Exit) Regulations 2019")),
               nz.regime_subject(F.lit("The Cyber Regulations"))) == ("Russia", None)
    assert one(spark, nz.surrogate_key(F.lit("a"), F.lit(None).cast("string"))) == (None,)


GOLDEN = [  # a, b, ratio, token-sorted ratio
    ("ACME", "ACME", 100, 100), ("", "", 100, 100), ("SMITH SONS", "SONS SMITH", 50, 100),
    ("MEC OM", "MEC COM", 200 * 6 / 13, 200 * 3 / 13), ("ABCD", "WXYZ", 0, 0),
]


@pytest.mark.parametrize("a,b,ratio,token", GOLDEN)
def test_ratios(a, b, ratio, token):
    assert sim.indel_ratio_py(a, b) == pytest.approx(ratio)
    assert sim.token_sort_ratio_py(a, b) == pytest.approx(token)
    assert sim.lcs_batch([a], [b])[0] == sim.lcs_length(a, b)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("ABC é", max_size=80), st.text("ABC é", max_size=80))
def test_lcs_and_batches(a, b):
    assert sim.lcs_length(a, b) == slow_lcs(a, b) == sim.lcs_batch([a, b], [b, a])[0]
    assert sim.score_batch([a], [b])[0] == sim.match_score_py(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("ABCD 1", max_size=14), st.text("ABCD 1", max_size=14))
def test_jaro_winkler_like_duckdb(a, b):
    want = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
    assert sim.jaro_winkler_py(a, b) == pytest.approx(want, abs=1e-12)


def test_udfs_handle_nulls(spark):
    df = spark.createDataFrame([("AB", "AC"), (None, "A"), ("", "A")], "a string, b string")
    got = [tuple(r) for r in df.select(sim.match_score("a", "b"), sim.jaro_winkler("a", "b")).collect()]
    assert got[0][0] == 50.0 and got[1] == (None, None) and got[2] == (0.0, 0.0)
