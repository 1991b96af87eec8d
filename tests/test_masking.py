import pytest
from pyspark.sql import functions as F, types as T

from ferry.functions import masking
from ferry.operators import mask
from tests.conftest import rows

FULL, FIVE = "*" * 8, "*" * 5


@pytest.mark.parametrize(
    "name, value, shown",
    [
        ("password", "super_secret_123", FULL),
        ("user_password", "x", FULL),
        ("pwd", "x", FULL),
        ("email", "john@gmail.com", "j***@gmail.com"),
        ("email", "j@gmail.com", "***@gmail.com"),
        ("email", "a@b@c.de", FULL),
        ("email", "john@gmail.com\n", FULL),
        ("phone", "9876543210", "98******10"),
        ("phone", "+91 (987) 654-3210", "91********10"),
        ("phone", "123-45", FULL),
        ("salary", "95000", FIVE),
        ("credit_card", "4111111111111111", FIVE),
        ("card_phone", "9876543210", "98******10"),
        ("first_name", "John", FULL),
        ("address", "1 Road", FULL),
        ("password", None, "NULL"),
        ("salary", None, "NULL"),
    ],
)
def test_mask_value(spark, name, value, shown):
    df = spark.createDataFrame([(value,)], "v string").select(masking.mask_value(name, F.col("v")).alias("m"))
    assert df.first().m == shown


@pytest.mark.parametrize("digits, shown", [("1234", "****"), ("12345", "12*45"), ("", "")])
def test_short_phone(spark, digits, shown):
    assert spark.createDataFrame([(digits,)], "v string").select(masking.mask_phone(F.col("v"))).first()[0] == shown


@pytest.mark.parametrize("name", ["password", "user_email", "phone_number", "api_key", "API-Key", "company"])
def test_sensitive_names(spark, name):
    assert masking.is_sensitive(name)
    assert spark.createDataFrame([(name,)], "n string").select(masking.is_sensitive_name(F.col("n"))).first()[0]


@pytest.mark.parametrize("name", ["first_name", "department", "id"])
def test_plain_names(spark, name):
    assert not masking.is_sensitive(name)
    assert not spark.createDataFrame([(name,)], "n string").select(masking.is_sensitive_name(F.col("n"))).first()[0]


def test_word_match_does_not_overmask():
    assert not masking.is_sensitive("company", word_match=True)
    assert masking.is_sensitive("pan_no", word_match=True)
    assert masking.is_sensitive("badge", extra=("badge",))


@pytest.mark.parametrize("kind, binary", [("bytea", True), ("blob", True), ("BLOB", True), (" varbinary ", True), ("text", False), ("integer", False)])
def test_binary_types(kind, binary):
    assert mask.is_binary_type(kind) is binary


def test_engine_binary_types():
    assert mask.is_binary_type("geometry", "MYSQL") and not mask.is_binary_type("geometry")
    assert mask.is_binary_type("rowversion", "SQL_SERVER")


def test_mask_table_touches_sensitive_columns_only(spark):
    df = spark.createDataFrame([(1, "John", "john@gmail.com", "secret", "IT")], "id int, first_name string, email string, password string, department string")
    assert rows(mask.mask_table(df)) == [(1, "John", "j***@gmail.com", FULL, "IT")]
    assert mask.masked_names(df) == ["email", "password"]


def test_preview_leaves_out_binary_and_sorts(spark):
    df = spark.createDataFrame([(i, "a@b.cd", bytearray(b"x")) for i in range(9, 0, -1)], "id int, email string, photo binary")
    shown = mask.preview_rows(df, "id", 3)
    assert shown.columns == ["id", "email"]
    assert [tuple(r) for r in shown.collect()] == [(i, "***@b.cd") for i in (1, 2, 3)]
    assert not any(isinstance(f.dataType, T.BinaryType) for f in shown.schema)
