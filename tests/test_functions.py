"""Column functions, case by case."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from ratecraft.functions import clusters as C, dates as D, documents as J, numbers as N, rates as R, reasons as E, similarity as S, text as T
from ratecraft.operators.amounts import premium_validation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(value):
    return F.lit(value).cast("string") if value is None else F.lit(value)


@pytest.mark.parametrize("raw, want", [("4,151.00", 4151.0), ("", 0.0), (None, 0.0), (" Null ", 0.0), ("1870..00", None), ("-12", -12.0)])
def test_clean_amount(spark, raw, want):
    assert one(spark, N.clean_amount(lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("MH05FG9876", "MH05"), ("GJ-19", "GJ19"), ("UP 32", "UP32"), (None, ""), ("nan", "")])
def test_rto_code(spark, raw, want):
    assert one(spark, T.normalize_rto_code(lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("2024", 2024), ("15-03-2024", 2024), ("2024-03-15 00:00:00", 2024), ("20245", None), (None, None)])
def test_extract_year(spark, raw, want):
    assert one(spark, D.extract_year(lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("31/07/2027", (2027, 7, 31)), ("2027-07-31", (2027, 7, 31)), ("1-8-2026", (2026, 8, 1)), ("x", None)])
def test_policy_date(spark, raw, want):
    assert one(spark, D.policy_date(lit(raw))) == (datetime.date(*want) if want else None)


@pytest.mark.parametrize("raw, year", [("05/03/98", 1998), ("05/03/69", 1969), ("05/03/68", 2068)])
def test_two_digit_years(spark, raw, year):
    assert one(spark, D.document_date(lit(raw))).year == year


def test_model_words(spark):
    assert sorted(one(spark, T.model_words(F.lit("HONDA ACTIVA6G CITY-1.5")))) == ["1.5", "6G", "ACTIVA", "CITY", "HONDA"]


def test_tenure_is_half_even(spark):
    start = datetime.date(2024, 1, 1)
    days = {0: None, 182: 0, 183: 1, 365: 1, 913: 2, 914: 3}
    for n, want in days.items():
        assert one(spark, D.tenure_years(F.lit(start), F.lit(start + datetime.timedelta(days=n)))) == want


def test_safe_decimal(spark):
    assert one(spark, N.safe_decimal(F.lit("Rs 1,234.50"))) == decimal.Decimal("1234.50")


def test_split_rate_and_amount_text(spark):
    assert one(spark, R.split_rate_text(F.lit(13.0), F.lit(8.5))) == "13+8.5"
    assert one(spark, N.amount_text(F.lit(6725.88))) == "6,725.88"
    assert one(spark, N.amount_text(F.lit(4150.0))) == "4,150"
    assert one(spark, N.number_text(F.lit(47500000.0))) == "47500000.0"


def test_signature_tells_types_and_legs_apart(spark):
    def sign(kind, od, tp, net):
        cols = {"po_type": kind, "po_od_rate": od, "po_tp_rate": tp, "po_net_rate": net}
        frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()], *[F.lit(v).alias(k.replace("po", "pi", 1)) for k, v in cols.items()])
        return frame.select(R.payout_signature()).first()[0]

    assert sign("On OD and TP", 10.0, 5.0, 0.0) != sign("On OD and TP", 5.0, 10.0, 0.0)
    assert sign("On OD", 10.0, 1.0, 2.0) == sign("On OD", 10.0, 7.0, 9.0)
    assert sign("On OD", 10.0, 0.0, 0.0) != sign("On Net", 0.0, 0.0, 10.0)


def test_reason_round_trip(spark):
    text = "Failed on: Policy: fuel — Value 'x' did not match | Also failed on: Policy: cpa — CPA value 1.0 is wrong"
    pairs = one(spark, E.split_failed_on(F.lit(text)))
    assert [tuple(p) for p in pairs] == [("Policy: fuel", "Value 'x' did not match"), ("Policy: cpa", "CPA value 1.0 is wrong")]
    assert one(spark, E.split_failed_on(F.lit("No rates found for criteria"))) == []


def test_unresolved_value_keeps_apostrophes(spark):
    text = "Failed on: Policy: vehicle make / model — Vehicle make/model 'bmw 3's  series' did not share at least 2 words with any"
    assert one(spark, E.unresolved_make_value(F.lit(text))) == "bmw 3's series"
    other = "Failed on: Policy: vehicle make / model — Vehicle make/model 'x y' resolved to master group(s) [a]"
    assert one(spark, E.unresolved_make_value(F.lit(other))) is None


def test_group_ids_ignore_the_tail(spark):
    assert one(spark, E.group_ids(F.lit("x Matching Group IDs: 3, 14 … (+5 more)"))) == [3, 14]


def test_cluster_preview(spark):
    assert one(spark, C.cluster_preview(F.array(*[F.lit(f"mh{i:02d}") for i in range(20)]))) == "mh00, mh01, mh02, mh03, mh04, mh05, mh06, mh07 +12 more"
    assert one(spark, C.cluster_preview(F.array(F.lit("x" * 100), F.lit("y")))) == "x" * 100 + " +1 more"
    assert one(spark, C.cluster_preview(F.array().cast("array<string>"))) == "(blank)"


def test_search_params(spark):
    line = "Eligibility Check Parameters: {'product': ['12', '13'], 'holder': [\"O'Brien\"], 'empty': [], 'none': None}"
    assert one(spark, J.search_params(F.lit(line))) == {"product": "12", "holder": "O'Brien", "empty": "[]", "none": "None"}


@pytest.mark.parametrize("name, a, b, want", [
    ("ratio", "gcv 3w", "gcv 4w", 83.33), ("token_sort_ratio", "aspire gold plus", "aspire gold plus", 100.0),
    ("token_sort_ratio", "optima secure", "my optima secure", 89.66), ("token_sort_ratio", "arogya sanjeevani", "arogya sanjeevani policy", 82.93),
    ("token_sort_ratio", "optima", "optima plus", 70.59), ("token_sort_ratio", "optima", "optima restore", 60.0),
    ("token_set_ratio", "hero splendor", "hero motor splendor", 100.0), ("partial_ratio", "abcd", "xxabcdyy", 100.0), ("weighted_ratio", "", "a", 0.0)])
def test_similarity(name, a, b, want):
    assert S.score(name, a, b) == pytest.approx(want, abs=0.01)


@pytest.mark.parametrize("sub, product, od, tp, ncb, part", [
    ("STP", "tw", "0", "500", "0", None), ("STP", "tw", "4151", "500", "0", "total od is 4,151, but STP"), ("SAOD", "tw", "", "10", "", "total od is zero/blank, but SAOD"),
    ("1+1", "Private Car", "100", "null", "0", None), ("1+1", "tw", "0", "na", "0", "are both zero/blank"), ("1+3", "tw", "1", "1", "20", "no claim bonus is 20, but 1+3"),
    ("1+5", "tw", "1870..00", "1", "", "value '1870..00' is not a valid number"), ("3+3", "tw", "0", "0", "9", None)])
def test_premium_validation(spark, sub, product, od, tp, ncb, part):
    text = one(spark, premium_validation(*[F.lit(x) for x in (sub, product, od, tp, ncb)]))
    assert (text is None) if part is None else (part in text)


def test_payload_summary_works_out_each_row_once(spark):
    payload = {"Policy: model": "m", " Vehicle Make": "k", "x": "1", "Policy Type": "t", "sub product": "s", "empty": "", "none": None}
    frame = spark.createDataFrame([(payload,), ({"a": "1", "b": "", "c": "3", "d": "4", "e": "5"},), (None,)], "payload map<string,string>")
    split = frame.select(E.payload_summary("payload").alias("s")).select(
        *[F.transform(f"s.{part}", lambda e: e["value"]).alias(part) for part in ("summary", "rest")])
    assert [(r["summary"], r["rest"]) for r in split.collect()] == [(["k", "m", "t"], ["1", "s"]), (["1", "3", "4"], ["5"]), (None, None)]
    # entries are listed in one place of the plan, however often they are named
    assert split._jdf.queryExecution().optimizedPlan().toString().count("map_entries") == 1
