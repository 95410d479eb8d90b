from pyspark.sql import functions as F

from tessera.functions import classify as cl


def test_rules(spark):
    rows = [
        ("Введены новые САНКЦИИ против банка после матча", "sanctions"), ("Команда выиграла матч", "noise"), ("Погода хорошая", "other"), ("Выручка компании растёт", "earnings"), (None, "other"), ("Банк снизил ключевую ставку", "macro"),
    ]
    d = spark.createDataFrame(rows, "t string, want string")
    assert all(r.e == r.want for r in d.withColumn("e", cl.event_type(F.col("t"))).collect())
    got = d.select("t", cl.themes(F.col("t")).alias("th")).collect()
    assert got[5].th == ["Ключевая ставка"] and got[0].th == ["Санкции"] and got[4].th == []


def test_scores(spark):
    d = spark.createDataFrame([("Прибыль и рост, но риск",), ("нет слов",), (None,), ("Обвал. Кризис.",)], "t string")
    got = d.select(cl.lexicon_score(F.col("t")).alias("s")).withColumn("l", cl.sentiment(F.col("s"))).collect()
    assert [(r.s, r.l) for r in got] == [(0.333, "positive"), (0.0, "neutral"), (0.0, "neutral"), (-1.0, "negative")]
    s = spark.createDataFrame([("sanctions", -1.0, [0.7, 0.9]), ("strange", None, None)], "e string, s double, r array<double>")
    got = s.select(cl.significance(F.col("e"), F.col("s"), F.col("r")).alias("v")).withColumn("b", cl.bucket(F.col("v"))).collect()
    assert [(r.v, r.b) for r in got] == [(1.0, "high"), (0.05, "low")]
    assert d.limit(1).select(cl.clean(F.lit("<p>a  b</p>\n1 < 2")).alias("c")).first().c.startswith("a b")
