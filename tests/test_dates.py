"""Dates in texts, and facts that need what stands before or behind them."""

from datetime import date

import pytest

from tessera.functions import dates as dt
from tessera.functions import text as tx

PUB = date(2026, 6, 12)


@pytest.mark.parametrize(
    ("text", "published", "want"),
    [
        ("Отсечка 10 июля 2026 года", PUB, [date(2026, 7, 10)]),
        ("собрание 15 января", date(2025, 12, 20), [date(2026, 1, 15)]),
        ("итоги на 30 декабря", date(2026, 1, 10), [date(2025, 12, 30)]),
        ("отчёт 15.06.2026 и 15.06.26", PUB, [date(2026, 6, 15)]),
        ("Вчера и ЗАВТРА, послезавтра", PUB, [date(2026, 6, 11), date(2026, 6, 13), date(2026, 6, 14)]),
        ("позавчера", PUB, [date(2026, 6, 10)]),
        ("завтрашний день, повчера", PUB, []),
        ("31 февраля, 45.13.2026, 5 мая 1999, 01.01.2030", PUB, []),
        ("версия 10.01.20265 и 110.01.2026", PUB, []),
        ("29 февраля", date(2025, 3, 1), [date(2024, 2, 29)]),
        ("1 июня, потом 20 июня 2026, сегодня", PUB, [date(2026, 6, 1), date(2026, 6, 20), PUB]),
        ("111 июня", PUB, []),
        (None, PUB, []), ("", PUB, []), ("10 июля 2026", None, []),
    ],
)
def test_event_dates(spark, text, published, want):
    d = spark.createDataFrame([(text, published)], "t string, p date")
    assert d.select(dt.event_dates(d.t, d.p).alias("x")).first().x == want


def test_anchor(spark):
    ds = [date(2026, 6, 1), date(2026, 6, 12), date(2026, 6, 20), date(2026, 7, 1)]
    rows = [(s, x) for s in ("future", "past", "forecast", "none", None) for x in (ds, [])]
    d = spark.createDataFrame([(s, x, PUB) for s, x in rows], "s string, x array<date>, p date")
    assert [r.a for r in d.select(dt.anchor(d.x, d.p, d.s).alias("a")).collect()] == [date(2026, 6, 20), None, date(2026, 6, 12), None, None, None, None, None, None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("слово " * 60 + "Банк повысил ключевую ставку до 18%", [("key_rate", 18.0, "pct")]),
        ("ожидается рост. " + "текст " * 15 + "ключевая ставка составляет 9%", [("key_rate", 9.0, "pct")]),
        ("может быть, ключевая ставка составляет 9%", []),
        ("Перепродал долю за 5 млрд рублей", []),
        ("Продал долю за 5 млрд рублей", [("deal_amount", 5e9, "RUB")]),
        ("Купил. " + "текст " * 20 + "за 5 млрд рублей", []),
        ("Выкупили за 3 млн евро, потом ещё за 4 млн евро", [("deal_amount", 3e6, "EUR"), ("deal_amount", 4e6, "EUR")]),
    ],
)
def test_windows_before_facts(spark, text, want):
    got = tx.numeric_facts(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert sorted((r.kind, round(r.value, 6), r.unit) for r in got) == want


def test_report_metrics(spark):
    rows = [
        (1, "За 9 месяцев 2025 года выручка составила 7 200,5 млрд руб., чистая прибыль 120 млн долларов. P/E 5,2"), (2, "EBITDA: 1 трлн рублей; прибыль на акцию 34,84 руб. на акцию"),
        (3, "дивиденды 10 руб. на акцию за 2024"), (4, "выручка " + "х" * 100 + " 5 млрд руб."), (5, None), (6, "выручки не было, выручка 3 тыс. юаней в 1 квартале 2023"), (7, "Первое полугодие 2022: активы составили 2 млн евро"),
    ]
    got = sorted(map(tuple, tx.report_metrics(spark.createDataFrame(rows, "doc_id int, text string")).collect()))
    assert got == [
        (1, "net_profit", 120e6, "USD", "2025-9M"), (1, "pe", 5.2, "ratio", "2025-9M"), (1, "revenue", 7200.5e9, "RUB", "2025-9M"), (2, "ebitda", 1e12, "RUB", None), (2, "eps", 34.84, "RUB", None),
        (3, "dividend", 10.0, "RUB", "2024"), (6, "revenue", 3e3, "CNY", "2023-Q1"), (7, "assets", 2e6, "EUR", "2022-H1"),
    ]


def test_forecast_posts(spark):
    rows = [("Целевая цена бумаги", None, "x", None), ("Ожидаем сильный отчёт", "рост 5%", "broker", None), ("Ожидаем сильный отчёт", "рост 5%", "x", None), ("Ждём отчёт", None, "broker", "forecast"), ("Ждём отчёт", None, "broker", None), ("", "таргет", "x", None), (None, "таргет", "x", None), ("Новость", "рекомендуем покупать", None, None)]
    d = spark.createDataFrame(rows, "t string, b string, c string, s string")
    assert [r.f for r in d.select(tx.is_forecast(d.t, d.b, ("broker",), d.c, d.s).alias("f")).collect()] == [True, True, False, True, False, False, False, True]
