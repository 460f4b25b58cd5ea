import pytest
from pyspark.sql import functions as F

from sottovoce.functions import numbers, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("my code is one two three", ["123"]),
        ("double five one", ["551"]),
        ("triple zero dash four", ["0004"]),
        ("no do oh", []),  # only words that mean something else
        ("no seven do", ["972"]),
        ("12 34 and 56", ["123456"]),
        ("12 apples 34", []),
        ("double then one two three", ["123"]),
        ("one two", []),
        ("", []),
    ],
)
def test_digit_runs(spark, given, expected):
    assert one(spark, numbers.digit_runs(text.normalize(F.lit(given)))) == expected


@pytest.mark.parametrize(("n", "ok"), [("4539578763621486", True), ("4539578763621487", False), ("0", True), ("79927398713", True)])
def test_luhn(spark, n, ok):
    assert one(spark, numbers.luhn(F.lit(n))) is ok


@pytest.mark.parametrize(
    ("n", "kind"),
    [("123456", None), ("0123456", "phone"), ("1234567", None), ("123456789", "long_number"), ("03001234567", "phone"), ("923001234567", "phone"), ("1234567890123", "cnic"), ("4539578763621486", "payment_card"), ("4539578763621487", "long_number")],
)
def test_classify(spark, n, kind):
    assert one(spark, numbers.classify(F.lit(n))) == kind


def test_mask(spark):
    assert one(spark, numbers.mask(F.lit("123456"))) == "******"
    assert one(spark, numbers.mask(F.lit("123456789"))) == "123***789"


def test_addresses(spark):
    assert one(spark, numbers.written_ipv4(F.lit("at 10.0.0.1, not 300.1.1.1 or ک192.168.1.1"))) == ["10.0.0.1"]
    assert one(spark, numbers.spoken_ipv4(text.normalize(F.lit("one nine two dot one six eight dot zero dot one")))) == ["192.168.0.1"]
    assert one(spark, numbers.spoken_ipv4(text.normalize(F.lit("1 dot 2 dot 3")))) == []


def test_ibans(spark):
    assert one(spark, numbers.ibans(F.lit("to de89 3704 0044 0532 0130 00 now"))) == ["de89370400440532013000"]
    assert one(spark, numbers.ibans(F.lit("ab12 cdef"))) == []


def test_scan_orders_and_disables(spark):
    rules = {"payment_card": (0.9, "Card"), "ipv4": (0.6, "IP")}
    folded = F.lit("host 10.0.0.1 card 4539578763621486 phone 03001234567")
    hits = one(spark, numbers.scan(folded, numbers.long_runs(folded, text.fold_marks), numbers.quads(folded, text.fold_marks), rules))
    assert [(h["pattern"], h["phrase"]) for h in hits] == [("payment_card", "Card: 453**********486"), ("ipv4", "IP: 10.0.0.*")]
