import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from mascate.functions import keys, text
from mascate.functions.calendar import DateWindow, add_months, month_start, resolve_window


def values(spark, column, items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i INT, v STRING")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_title_case(spark):
    names = ["ANA SOUZA", "ANA-MARIA", "d'avila", "ÁGATA", "x1 2y _z", None, ""]
    assert values(spark, text.title_case, names) == [
        "Ana Souza", "Ana-Maria", "D'Avila", "áGata", "X1 2y _z", None, "",
    ]
    assert values(spark, lambda c: text.title_case(c, accented_words=True), ["ÁGATA SÃO-JOSÉ"]) == ["Ágata São-José"]


def test_masks(spark):
    ids = ["12345678901234", "12.345.678/9012-34", "123", "12345678901", "123.456.789-01", None]
    assert values(spark, text.mask_tax_id14, ids) == [
        "12.345.678/9012-34", "12.345.678/9012-34", "123", "12345678901", "123.456.789-01", None,
    ]
    # The short mask does not strip punctuation first.
    assert values(spark, text.mask_tax_id11, ids) == [
        "12345678901234", "12.345.678/9012-34", "123", "123.456.789-01", "123.456.789-01", None,
    ]
    assert values(spark, text.mask_tax_id, ["39820883000111", "12232112313", "7"]) == [
        "39.820.883/0001-11", "122.321.123-13", "7",
    ]


def test_digests(spark):
    words = ["secret", " secret\t\n", " secret﻿", ""]
    md5 = hashlib.md5(b"secret").hexdigest()
    assert values(spark, text.password_digest, words) == [md5, md5, md5, hashlib.md5(b"").hexdigest()]
    assert values(spark, text.text_digest, [" a "]) == [hashlib.sha256(b" a ").hexdigest()]
    assert values(spark, text.login_key, ["  ana.s \n"]) == ["ANA.S"]


def test_tax_keys(spark):
    ids = ["123.456.789-01", "1", "", None, "123456789012345"]
    assert values(spark, keys.digits, ids) == ["12345678901", "1", "", None, "123456789012345"]
    assert values(spark, keys.tax_id14, ids) == [
        "00012345678901", "00000000000001", "00000000000000", None, "12345678901234",
    ]
    assert values(spark, keys.tax_id14_uncut, ids) == [
        "00012345678901", "00000000000001", "00000000000000", "00000000000000", "123456789012345",
    ]


def test_phone(spark):
    df = spark.createDataFrame(
        [
            (1, " 11 ", "9 8765", "11", "3222"),
            (2, "11", "0000", "12", " 3222 "),
            (3, None, None, None, None),
            (4, None, "7", "1", "2"),
            (5, "11", "", "12", "0"),
        ],
        "i INT, ma STRING, m STRING, la STRING, l STRING",
    )
    args = [F.col(c) for c in ("ma", "m", "la", "l")]
    got = df.select("i", keys.phone_of(*args), keys.phone_of(*args, blank_as_null=True)).orderBy("i")
    assert [tuple(r)[1:] for r in got.collect()] == [
        ("11 9 8765", "11 9 8765"),
        ("12 3222", "12 3222"),
        (" ", None),
        (" 7", " 7"),
        ("12 0", "12 0"),
    ]


def test_visible(spark):
    df = spark.createDataFrame([(s,) for s in (None, 1, 6, 8, 9, 95, 10)], "s INT")
    kept = df.where(keys.visible(F.col("s"))).collect()
    assert {r.s for r in kept} == {None, 1, 10}


def test_windows():
    day = date(2026, 3, 17)
    assert resolve_window(day) == DateWindow(date(2025, 4, 1), None)
    assert resolve_window(day, months=1) == DateWindow(date(2026, 3, 1), None)
    assert resolve_window(day, months=0) == DateWindow(date(2025, 4, 1), None)
    assert resolve_window(day, month="2025-12", months=3) == DateWindow(date(2025, 12, 1), date(2026, 1, 1))
    assert resolve_window(day, end=day, month="2025-12") == DateWindow(None, date(2026, 3, 18))
    assert resolve_window(day, start=day) == DateWindow(day, None)
    assert add_months(date(2026, 1, 31), -2) == date(2025, 11, 1)
    assert month_start(None, day) == month_start("2026-03-09", day) == date(2026, 3, 1)
    for bad in ("2026/03", "03-2026", "x"):
        with pytest.raises(ValueError):
            month_start(bad, day)
    with pytest.raises(ValueError):
        resolve_window(day, month="2026-13")
    with pytest.raises(ValueError):
        resolve_window(day, month="2026-03-01")
