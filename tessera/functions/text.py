"""Facts in Russian news texts as column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of unconfirmed news, marks of opinion, multipliers, currencies.
RUMOR = (
    r"по\s+данным\s+источник", r"сообща\w*\s+источник", r"источник\w*\s+(?:сообща|расска|утвержда)", r"по\s+(?:нашей\s+)?информации", r"по\s+слухам", r"\bслух\w*", r"инсайдер\w*",
    r"неофициальн\w*", r"\bякобы\b", r"предположительн\w*", r"не\s+подтвержд\w*", r"\bне\s+исключ\w*", r"СМИ\s+сообща\w*", r"анонимн\w*\s+источник",
)
OPINION = (r"на\s+мой\s+взгляд", r"\bпо-моему\b", r"\bсчита\w*,?\s+что", r"\bмнени\w*", r"\bимхо\b", r"как\s+по\s+мне", r"\bкажется,", "🗣")
MULTIPLIER = {"тыс": 1e3, "млн": 1e6, "млрд": 1e9, "трлн": 1e12}
CURRENCY = {"руб": "RUB", "долл": "USD", "евро": "EUR", "юан": "CNY", "$": "USD", "€": "EUR", "₽": "RUB"}

FLAGS = "(?iuU)"
NUMBER = r"([0-9]{1,3}(?:\s[0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"


def marks(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns a text holds."""
    return sum((F.coalesce(text.rlike(FLAGS + p).cast("int"), F.lit(0)) for p in patterns[1:]), F.coalesce(text.rlike(FLAGS + patterns[0]).cast("int"), F.lit(0)))


def factuality(docs: DataFrame, text: str = "text", forecast: str | None = None) -> DataFrame:
    """docs with label (opinion before rumor before fact) and confidence; a forecast makes a rumor surer, not a fact a rumor."""
    t = F.col(text)
    d = docs.withColumns({"_o": marks(t, OPINION), "_r": marks(t, RUMOR)})
    more = F.when(F.col(forecast), 0.15).otherwise(0.0) if forecast else F.lit(0.0)
    label = F.when(F.col("_o") > 0, "opinion").when(F.col("_r") > 0, "rumor").otherwise("fact")
    sure = F.when(F.col("_o") > 0, F.least(F.lit(0.95), 0.5 + 0.2 * F.col("_o"))).when(F.col("_r") > 0, F.least(F.lit(0.95), 0.55 + 0.15 * F.col("_r") + more))
    sure = sure.when(F.coalesce(t, F.lit("")) == "", 0.3).otherwise(0.5)
    return d.withColumns({"label": label, "confidence": F.round(sure, 3)}).drop("_o", "_r")


def number(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", ""), ",", ".").try_cast("double")


def _unit(sign: Column, word: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in CURRENCY.items():
        out = F.when((F.trim(sign) == k) | F.lower(F.trim(word)).startswith(k), v).otherwise(out)
    return out


# The phrases around a dividend, a key rate, a deal and a target price, and those of expectation.
MONEY = r"(руб[а-яё.]*|долл[а-яё.]*|евро|юан[а-яё]*|₽|\$)?"
DIVIDEND = rf"дивиденд[а-яё]*[^;!?]{{0,80}}?(₽\s*)?{NUMBER}\s*(руб[а-яё.]*|₽)?\s+на\s+(?:одну\s+|обыкновенную\s+|привилегированную\s+)?акци"
KEY_RATE = rf"ключев(?:ая|ой|ую)\s+ставк[а-яё]*[^;!?]{{0,80}}?(?:до|на\s+уровне|составля[а-яё]+|в\s+размере)\s*{NUMBER}\s*%"
AMOUNT = rf"\bза\s+(?:около|примерно|почти)?\s*([$€₽])?\s*{NUMBER}\s*(тыс|млн|млрд|трлн)\.?\s*(руб[а-яё.]*|долл[а-яё.]*|евро|юан[а-яё]*)?"
DEAL = r"\b(?:сделк|выкуп|приобрет|приобрел|закупи|купи[лт]|покупк|продал|прода[её]т|оценив)"
TARGET = rf"(?:целев(?:ая|ой|ую)\s+цен[а-яё]*|таргет[а-яё]*|справедлив(?:ая|ой|ую)\s+(?:цен[а-яё]*|стоимост[а-яё]*))[^;!?%]{{0,60}}?([$€₽]\s*)?{NUMBER}\s*{MONEY}"
EXPECTED = r"\b(?:ожида|допуст|прогноз|может|вероятн|не\s+исключ)"
#: Characters before a rate, and before an amount, in which such words are looked for.
RATE_WINDOW, DEAL_WINDOW = 80, 100
STRONG = (r"целев(?:ая|ой|ую)\s+цен", r"\bтаргет\w*", r"справедлив(?:ая|ой|ую)\s+(?:цен|стоимост)", r"потенциал\s+рост", r"\bапсайд\w*", r"\bupside\b", r"рекоменд\w*\s+(?:покупа|держа|продава)", r"рекомендаци\w*[:\s]+(?:покупа|держа|продава)", r"взгляд\s+на\s+акци")
SOFT = (r"\bожида\w*", r"\bпрогнозиру\w*", r"\bпрогноз\b", r"\bжд[её]м\b", r"по\s+нашим\s+оценк", r"\bоценива\w*\s+потенциал")


def before(n: int) -> str:
    """A group in front of a match that takes in the n characters before it, or all there are, without consuming them. It tries
    every length up to n: put what the match begins with before it, as a look ahead."""
    return rf"(?<=(\A[\s\S]{{0,{n - 1}}}|[\s\S]{{{n}}}))"


def is_forecast(title: Column, body: Column, brokers: tuple[str, ...] = (), channel: Column | None = None, status: Column | None = None) -> Column:
    """A post that forecasts: strong marks anywhere; on a broker's channel soft ones too, with a number or the status forecast. Never without a title."""
    t = F.concat(title, F.lit(". "), F.coalesce(body, F.lit("")))
    soft = F.lit(False)
    if brokers and channel is not None:
        sure = t.rlike("[0-9]") if status is None else F.coalesce(status == "forecast", F.lit(False)) | t.rlike("[0-9]")
        soft = F.coalesce(channel.isin(*brokers), F.lit(False)) & (marks(t, SOFT) > 0) & sure
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(False)).otherwise((marks(t, STRONG) > 0) | soft)


def numeric_facts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, value, unit), each fact of a text once: dividend a share, key rate, deal amount, target price.

    Amounts need a currency; a rate is left out if it, or the 80 characters before it, say that it is only expected; a
    deal needs a verb of dealing in the 100 characters before it. Null and empty texts have no facts."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = lambda p: F.regexp_extract_all(t, F.lit(FLAGS + p), F.lit(0))
    part = lambda m, p, i: F.regexp_extract(m, FLAGS + p, i)
    none = F.lit("")
    fact = lambda kind, value, unit: F.struct(F.lit(kind).alias("kind"), value.alias("value"), unit.alias("unit"))
    times = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in MULTIPLIER.items() for x in kv]), F.lower(m))
    rate, deal = "(?=ключев)" + before(RATE_WINDOW) + KEY_RATE, r"(?=за\s)" + before(DEAL_WINDOW) + AMOUNT
    # the groups of all matches as columns of their own, so that each is taken once a text
    groups = {f"_{k}{i}": F.regexp_extract_all("_t", F.lit(FLAGS + p), F.lit(i)) for k, p, n in (("r", rate, 3), ("d", deal, 6)) for i in range(n)}
    docs = docs.select(id, t.alias("_t")).select(id, "_t", *[c.alias(k) for k, c in groups.items()])
    t = F.col("_t")
    expected = lambda i: F.concat(F.get("_r1", i), F.get("_r0", i)).rlike(FLAGS + EXPECTED)
    bought = lambda i: F.get("_d1", i).rlike(FLAGS + DEAL)
    found = F.concat(
        F.transform(every(DIVIDEND), lambda m: fact("dividend", number(part(m, DIVIDEND, 2)), F.when((part(m, DIVIDEND, 1) != "") | (part(m, DIVIDEND, 3) != ""), F.lit("RUB")))),
        F.transform("_r2", lambda x, i: fact("key_rate", number(x), F.when(~expected(i), F.lit("pct")))),
        F.transform("_d3", lambda x, i: fact("deal_amount", number(x) * times(F.get("_d4", i)), F.when(bought(i), _unit(F.get("_d2", i), F.get("_d5", i))))),
        F.transform(every(TARGET), lambda m: fact("target_price", number(part(m, TARGET, 2)), _unit(F.coalesce(part(m, TARGET, 1), none), part(m, TARGET, 3)))),
    )
    rows = docs.select(id, F.explode(F.array_distinct(F.filter(found, lambda x: x["unit"].isNotNull() & x["value"].isNotNull()))).alias("x"))
    return rows.select(id, "x.kind", "x.value", "x.unit")


# The words of a metric, tried in order; characters behind them in which its number stands.
METRICS = {
    "revenue": ("выручка", "выручки", "выручку"), "net_profit": ("чистая прибыль", "чистой прибыли", "чистую прибыль"), "ebitda": ("ebitda", "oibda"),
    "assets": ("совокупные активы", "сумма активов", "активы составили", "итого активы"), "equity": ("собственный капитал", "капитал составил", "акционерный капитал"),
    "eps": ("прибыль на акцию", "eps"), "dividend": ("дивиденд", "дивиденды", "дивидендов"),
}
METRIC_WINDOW = 90
SCALED = r"([0-9][0-9 \x{A0}]*(?:[.,][0-9]+)?)\s*(тыс|млн|млрд|трлн)\.?\s*(руб[а-яё.]*|долл[а-яё.]*|\$|евро|юан[а-яё]*)"
PER_SHARE = r"([0-9]+(?:[.,][0-9]+)?)\s*(руб[а-яё.]*|долл[а-яё.]*|\$)\.?\s*на\s+акци"
PRICE_EARNINGS = r"p\s*/\s*e[^0-9]{0,12}([0-9]+(?:[.,][0-9]+)?)"
PERIODS = {"H1": r"1\s*полугоди|первое полугоди|6 месяц", "9M": r"9 месяц|девять месяц", "Q1": r"1 квартал|первый квартал", "Q3": r"3 квартал|третий квартал"}


def report_period(text: Column) -> Column:
    """The period of a report: the first year of 2020 to 2039, with a half, nine months or a quarter where one is named; null without a year."""
    year = F.regexp_extract(text, r"\b(20[2-3][0-9])\b", 1)
    out = F.when(year != "", year)
    for mark, words in reversed(PERIODS.items()):
        out = F.when((year != "") & F.lower(text).rlike(words), F.concat(year, F.lit(f"-{mark}"))).otherwise(out)
    return out


def report_metrics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, metric, value, unit, period): of each metric the number behind the first of its words that a text holds, in roubles
    where no other currency is named; earnings and dividends a share, and price to earnings, as they stand."""
    times = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in MULTIPLIER.items() for x in kv]), F.lower(m))
    low, t, found = F.col("_low"), F.col("_t"), []
    places = {}
    for metric, triggers in METRICS.items():
        at = F.lit(None).cast("struct<at:int,size:int>")
        for w in reversed(triggers):
            at = F.when(low.contains(w), F.struct(F.instr(low, w).alias("at"), F.lit(len(w)).alias("size"))).otherwise(at)
        places[metric] = at
    # each step in a projection of its own: what several columns read is worked out once
    rows = docs.select(id, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_low", F.lower("_t"))
    rows = rows.select(id, "_t", report_period(t).alias("period"), *[c.alias(f"_{m}") for m, c in places.items()])
    rows = rows.select(id, "_t", "period", *[F.substring(t, F.col(f"_{m}.at"), F.col(f"_{m}.size") + METRIC_WINDOW).alias(f"_{m}") for m in METRICS])
    for metric in METRICS:
        share = metric in ("eps", "dividend")
        part = lambda i, p=FLAGS + (PER_SHARE if share else SCALED), w=f"_{metric}": F.regexp_extract(w, p, i)
        value = number(part(1)) * (F.lit(1.0) if share else times(part(2)))
        found.append(F.when(F.col(f"_{metric}").isNotNull(), F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.coalesce(_unit(F.lit(""), part(2 if share else 3)), F.lit("RUB")).alias("unit"))))
    found.append(F.struct(F.lit("pe").alias("metric"), number(F.regexp_extract(t, FLAGS + PRICE_EARNINGS, 1)).alias("value"), F.lit("ratio").alias("unit")))
    rows = rows.select(id, "period", F.explode(F.filter(F.array(*found), lambda x: x["value"].isNotNull())).alias("x"))
    return rows.select(id, "x.metric", "x.value", "x.unit", "period")
