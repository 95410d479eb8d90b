"""Queries of the text rules. The supplied tables hold no Russian news, so each event writes one: a phrase by its number, with
its own values and dates. The SQL does not read these texts: it says from the same values what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify, dates
from tessera.functions import text as tx
from tessera.plans.registry import register
from tessera.sources.tables import table

FILL = "'слово за словом ' || repeat('идёт рассказ ', 20)"
MONTH = "element_at(array({}), month({}))"

#: k: (text of the event, facts in it as SQL over event_id and value)
FACTS = {
    0: ("'Совет рекомендовал дивиденды в ' || replace(v, '.', ',') || ' рубля на акцию'", ("dividend", "v::double", "RUB")),
    1: (f"{FILL} || '. Банк повысил ключевую ставку до ' || n || '%'", ("key_rate", "n::double", "pct")),
    2: ("'Аналитик ожидает, что ключевая ставка снизится до ' || n || '%'", None),
    3: ("'Холдинг купил завод за ' || n || ',5 млрд рублей'", ("deal_amount", "(n + 0.5::double) * 1000000000", "RUB")),
    4: ("'Перепродажа: за ' || n || ' млн рублей'", None),
    5: ("'таргет поднят до $' || n", ("target_price", "n::double", "USD")),
    6: ("'целевая цена ' || n || ' руб., прежняя целевая цена ' || n || ' руб.'", ("target_price", "n::double", "RUB")),
    7: ("'выручка выросла за год на ' || n || ' млрд рублей'", None),
    8: (f"'ожидается рост. ' || {FILL} || 'ключевая ставка составляет ' || n || '%'", ("key_rate", "n::double", "pct")),
    9: ("'дивиденды ' || n || ' на акцию'", None),
}
_FACT_ROWS = " ".join(f"union all select event_id, '{f[0]}', {f[1]}, '{f[2]}' from e where k = {k}" for k, (_, f) in FACTS.items() if f)[len("union all ") :]


def _news(spark, sf_dir, phrases: dict[int, str]):
    """(event_id, ts, text): the phrase of the event's number; v its value to two places, n a whole number of 1 to 97."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as date) as d", f"event_id % {len(phrases)} as k", "cast(cast(value as decimal(12, 2)) as string) as v", "cast(event_id % 97 + 1 as string) as n")
    case = "case k " + " ".join(f"when {k} then {x}" for k, x in phrases.items()) + " end"
    return e.select("event_id", "d", "k", F.expr(case).alias("text"))


@register("numeric_facts", f"with e as (select event_id, event_id % 10 as k, value::decimal(12, 2) as v, event_id % 97 + 1 as n from events) select event_id, kind, value, unit from ({_FACT_ROWS}) t(event_id, kind, value, unit)")
def numeric_facts(spark, sf_dir):
    return tx.numeric_facts(_news(spark, sf_dir, {k: t for k, (t, _) in FACTS.items()}), id="event_id")


_NAMES = ", ".join(f"'{m}'" for m in dates.MONTHS)


def _named(d: str, year: bool = True) -> str:
    return f"cast(day({d}) as string) || ' ' || element_at(array({_NAMES}), month({d}))" + (f" || ' ' || year({d})" if year else "")


NEAR, AFTER = "date_add(d, cast(event_id % 91 - 45 as int))", "date_add(d, cast(event_id % 30 + 2 as int))"
N, A = "(d + (event_id % 91 - 45)::int)", "(d + (event_id % 30 + 2)::int)"
#: k: (text, dates in it as SQL)
DATED = {
    0: (f"'Отсечка пройдёт ' || {_named(NEAR)} || ' года'", f"[{N}]"),
    1: (f"'СОБРАНИЕ ' || upper({_named(NEAR, False)})", f"[{N}]"),
    2: (f"'отчёт выйдет ' || date_format({NEAR}, 'dd.MM.yyyy')", f"[{N}]"),
    3: (f"'отчёт ' || date_format({NEAR}, 'd.M.yy') || ', повтор ' || date_format({NEAR}, 'dd.MM.yyyy')", f"[{N}]"),
    4: ("'вчера и послезавтра'", "[d - 1, d + 2]"),
    5: ("'Сегодня; позавчера подписан, завтра'", "[d, d - 2, d + 1]"),
    6: ("'31 февраля и 45.13.2024 и 5 мая 1999, 01.01.2030'", "[]::date[]"),
    7: ("'версия 10.01.20245, послезавтрашний день'", "[]::date[]"),
    8: (f"'завтра, ' || date_format({AFTER}, 'dd.MM.yyyy') || ', а сначала ' || {_named('date_sub(d, cast(event_id % 40 + 5 as int))')}", f"[d - (event_id % 40 + 5)::int, {A}, d + 1]"),
    9: ("'без дат'", "[]::date[]"),
}
_DATES = "case k " + " ".join(f"when {k} then {x}" for k, (_, x) in DATED.items()) + " end"


@register("event_dates", f"""with e as (select event_id, ts::date as d, event_id % 10 as k, ['future', 'past', 'none'][1 + event_id % 3] as status from events), x as (select *, {_DATES} as ds from e)
select event_id, status, array_to_string(list_transform(ds, lambda y: strftime(y, '%Y-%m-%d')), ',') as dates,
  case status when 'future' then list_min(list_filter(ds, lambda y: y > d)) when 'past' then list_max(list_filter(ds, lambda y: y <= d)) end::date as event_date from x""")
def event_dates(spark, sf_dir):
    d = _news(spark, sf_dir, {k: t for k, (t, _) in DATED.items()})
    d = d.withColumn("status", F.get(F.array(F.lit("future"), F.lit("past"), F.lit("none")), (F.col("event_id") % 3).cast("int")))
    d = d.withColumn("found", dates.event_dates(F.col("text"), F.col("d")))
    return d.select("event_id", "status", F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("dates"), dates.anchor(F.col("found"), F.col("d"), F.col("status")).alias("event_date"))


#: k: (text, event, sentiment, factuality, themes)
RULED = {
    0: ("'Введены новые САНКЦИИ, дефолт и обвал'", "sanctions", "negative", "fact", "Санкции"),
    1: ("'По слухам, дивиденды вырастут: рост и прибыль'", "dividends", "positive", "rumor", ""),
    2: ("'Слияние двух банков, без перемен'", "merger", "neutral", "fact", ""),
    3: ("'Отчётность: выручка и чистая прибыль, рекорд'", "earnings", "positive", "fact", ""),
    4: ("'На мой взгляд, законопроект примут'", "regulation", "neutral", "opinion", ""),
    5: ("'Банк снизил ключевую ставку, инфляция замедлилась'", "macro", "negative", "fact", "Инфляция,Ключевая ставка"),
    6: ("'Переговоры и саммит прошли'", "geopolitics", "neutral", "fact", "Геополитика"),
    7: ("'Команда выиграла матч, рост успеха'", "noise", "positive", "fact", ""),
    8: ("'Погода хорошая, имхо'", "other", "neutral", "opinion", ""),
    9: ("'Курс рубля: рубль подешевел, нефть brent, просадка'", "macro", "negative", "fact", "Курс валют,Нефть и сырьё"),
    10: ("'Якобы эмбарго снимут, оптимизм и риск'", "sanctions", "neutral", "rumor", "Санкции"),
}


def _case(at: int) -> str:
    return "case event_id % 11 " + " ".join(f"when {k} then '{x[at]}'" for k, x in RULED.items()) + " end"


@register("event_types", f"select event_id, {_case(1)} as event, {_case(2)} as sentiment, {_case(3)} as factuality, {_case(4)} as themes from events")
def event_types(spark, sf_dir):
    d = _news(spark, sf_dir, {k: x[0] for k, x in RULED.items()})
    d = tx.factuality(d)
    t = F.col("text")
    return d.select("event_id", classify.event_type(t).alias("event"), classify.sentiment(classify.lexicon_score(t)).alias("sentiment"), F.col("label").alias("factuality"), F.array_join(classify.themes(t), ",").alias("themes"))


_TYPE = "case event_id % 11 " + " ".join(f"when {k} then {w}" for k, w in ((0, 1.0), (1, 0.7), (2, 0.8), (3, 0.85), (4, 0.6), (5, 0.6), (6, 0.7), (7, 0.02), (8, 0.1), (9, 0.6), (10, 1.0))) + " end::double"


@register("significance", f"""with x as (select event_id, {_TYPE} as w, case when event_id % 5 = 0 then null else ((event_id % 21)::double - 10) / 8 end as score, (event_id % 4) * 0.4::double as links from events),
s as (select event_id, round(greatest(0, least(1, 0.5 * w + 0.3 * least(1, abs(coalesce(score, 0))) + 0.2 * least(1, links))), 3) as significance from x)
select event_id, significance, case when significance < 0.34 then 'low' when significance >= 0.66 then 'high' else 'medium' end as bucket from s""")
def significance(spark, sf_dir):
    """Of the event found in each text, a score, and the relevances of up to three links."""
    d = _news(spark, sf_dir, {k: x[0] for k, x in RULED.items()})
    score = F.when(F.col("event_id") % 5 != 0, ((F.col("event_id") % 21).cast("double") - 10) / 8)
    s = classify.significance(classify.event_type(F.col("text")), score, F.array_repeat(F.lit(0.4), (F.col("event_id") % 4).cast("int")))
    return d.select("event_id", s.alias("significance"), classify.bucket(s).alias("bucket"))


REPORTS = {
    0: ("'За 9 месяцев 2025 года выручка составила ' || n || ',5 млрд руб., P/E ' || n || ',2'", "2025-9M", (("revenue", "(n + 0.5::double) * 1000000000", "RUB"), ("pe", "n + 0.2::double", "ratio"))),
    1: ("'Первое полугодие 2022: чистая прибыль ' || n || ' млн долларов, активы составили ' || n || ' трлн рублей'", "2022-H1", (("net_profit", "n * 1000000::double", "USD"), ("assets", "n * 1000000000000::double", "RUB"))),
    2: ("'прибыль на акцию ' || v || ' руб. на акцию за 2024 год'", "2024", (("eps", "v::double", "RUB"),)),
    3: ("'выручка не раскрыта, капитал составил ' || n || ' млрд евро в 3 квартале 2023: 3 квартал'", "2023-Q3", (("revenue", "n * 1000000000::double", "EUR"), ("equity", "n * 1000000000::double", "EUR"))),
    4: (f"'выручка ' || {FILL} || n || ' млрд руб.'", None, ()),
}
_REPORT_ROWS = " union all ".join(f"select event_id, '{m}', {x}, '{u}', {'null' if p is None else repr(p)} from e where k = {k}" for k, (_, p, f) in REPORTS.items() for m, x, u in f)


@register("report_metrics", f"with e as (select event_id, event_id % 5 as k, value::decimal(12, 2) as v, event_id % 97 + 1 as n from events) select * from ({_REPORT_ROWS}) t(event_id, metric, value, unit, period)")
def report_metrics(spark, sf_dir):
    return tx.report_metrics(_news(spark, sf_dir, {k: x[0] for k, x in REPORTS.items()}), id="event_id")


POSTS = {0: ("'Целевая цена ' || n", None), 1: ("'Ожидаем сильный отчёт, ' || n", "desk"), 2: ("'Ожидаем сильный отчёт'", "desk"), 3: ("'Ждём отчёт ' || n", "wire"), 4: ("'Рекомендуем покупать'", "wire"), 5: ("''", "desk"), 6: ("'Завод открыт'", "desk")}


@register("forecast_posts", "select event_id, event_id % 7 in (0, 1, 4) as forecast from events")
def forecast_posts(spark, sf_dir):
    d = _news(spark, sf_dir, {k: x[0] for k, x in POSTS.items()})
    channel = F.element_at(F.create_map(*[x for k, (_, c) in POSTS.items() for x in (F.lit(k), F.lit(c).cast("string"))]), F.col("k").cast("int"))
    return d.select("event_id", tx.is_forecast(F.col("text"), F.lit(None).cast("string"), ("desk",), channel).alias("forecast"))
