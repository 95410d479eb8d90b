import pytest

from tessera.functions import text as tx


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Совет рекомендовал дивиденды в 12,5 рубля на акцию", [("dividend", 12.5, "RUB")]),
        ("дивиденды в размере ₽40 на обыкновенную акцию", [("dividend", 40.0, "RUB")]),
        ("дивиденды 5 на акцию", []),
        ("Банк повысил ключевую ставку до 18%", [("key_rate", 18.0, "pct")]),
        ("Аналитик ожидает, что ключевая ставка снизится до 9%", []),
        ("спрос вырос до 6,2%", []),
        ("Холдинг купил завод за 3,5 млрд рублей", [("deal_amount", 3.5e9, "RUB")]),
        ("Фонд продал долю за около $1 200 млн", [("deal_amount", 1.2e9, "USD")]),
        ("выручка выросла за год на 5 млрд рублей", []),
        ("целевая цена бумаги 410 руб", [("target_price", 410.0, "RUB")]),
        ("таргет поднят до $42", [("target_price", 42.0, "USD")]),
        ("таргет 350 по бумаге", []),
        ("Холдинг купил завод за 2 млн евро; повтор: купил завод за 2 млн евро", [("deal_amount", 2e6, "EUR")]),
        (None, []), ("", []),
    ],
)
def test_numeric_facts(spark, text, want):
    got = tx.numeric_facts(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert sorted((r.kind, round(r.value, 6), r.unit) for r in got) == want


def test_factuality(spark):
    rows = [(1, "Завод открыт.", False), (2, "По слухам, завод продадут.", False), (3, "По слухам, завод продадут.", True), (4, "На мой взгляд, по слухам не судят.", False), (5, None, False), (6, "Рубль вырастет.", True), (7, "ЯКОБЫ по данным источников и инсайдеров", False)]
    got = {r.doc_id: (r.label, r.confidence) for r in tx.factuality(spark.createDataFrame(rows, "doc_id int, text string, f boolean"), forecast="f").collect()}
    assert got[1] == ("fact", 0.5) and got[5] == ("fact", 0.3) and got[6] == ("fact", 0.5)
    assert got[2] == ("rumor", 0.7) or got[2][0] == "rumor"
    assert got[3][1] > got[2][1] and got[4][0] == "opinion" and got[7][1] == 0.95
