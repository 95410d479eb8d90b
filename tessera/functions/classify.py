"""Rule classifiers of Russian news as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuU)"

# Lexicon, event rules in their order, noise, themes, type weights.
POSITIVE = (
    "рост", "вырос", "выросли", "прибыль", "рекорд", "увеличил", "увеличение", "превысил", "улучшил", "позитив", "поддержка", "дивиденды", "успех", "укрепил",
    "восстановление", "оптимизм", "подъём", "рекордный", "повысил",
)
NEGATIVE = (
    "падение", "упал", "упали", "снижение", "снизил", "убыток", "санкции", "кризис", "обвал", "дефолт", "сократил", "сокращение", "потери", "риск", "угроза",
    "ослабил", "негатив", "проблемы", "штраф", "запрет", "просадка", "девальвация",
)
EVENTS = (
    ("sanctions", r"санкц|эмбарго|ограничени.{0,15}поставок|чёрн.{0,3}список"),
    ("dividends", r"дивиденд|выплат.{0,10}акционер|отсечк"),
    ("merger", r"слияни|поглощени|приобрел.{0,5}долю|сделк.{0,5}M&A|выкуп.{0,10}акц"),
    ("earnings", r"отчётност|отчетност|выручк|чист.{0,5}прибыл|чист.{0,5}убыт|EBITDA|финрезультат"),
    ("regulation", r"регулятор|законопроект|постановлени|ЦБ.{0,15}требовани|лицензи|налог"),
    ("macro", r"ключев.{0,5}ставк|инфляц|ВВП|курс.{0,5}рубл|нефт|бюджет|ставк.{0,5}ЦБ"),
    ("geopolitics", r"переговор|саммит|конфликт|дипломат|соглашени.{0,15}стран|внешн.{0,5}политик"),
    ("noise", r"теннис|футбол|хоккей|баскетбол|\bматч\b|турнир|чемпионат|олимпиад|спортсмен|\bдтп\b|\bавари[йяюе]|пожар|наводнени|землетрясени|ураган|\bфильм|кино|концерт|\bактёр|\bактер|певец|певиц|\bсериал|шоу-бизнес|фестивал|наркоман|ограблени"),
)
THEMES = {
    "Санкции": r"санкц|эмбарго|ограничени\w* (на )?поставк|чёрн\w* списк",
    "Инфляция": r"инфляц|подорожани|рост цен|индекс цен",
    "Ключевая ставка": r"ключев\w* ставк|ставк\w* цб|\bдкп\b|денежно-кредитн|(подня|повыс|сниз|сохран|поднял)\w* .{0,14}ставк",
    "Курс валют": r"курс\w* (рубл|доллар|евро|юан|валют)|девальв|рубл\w* (подешев|подорож|укреп|ослаб|просел)|(подешев|подорож|укреп|ослаб)\w* (рубл|к доллар|к евро)",
    "Нефть и сырьё": r"\bнефт|\bbrent\b|\bgaz\b|\bгаз\b|баррел|\bопек\b",
    "Геополитика": r"переговор|конфликт|саммит|геополит|спецоперац",
}
WEIGHT = {"sanctions": 1.0, "earnings": 0.85, "merger": 0.8, "dividends": 0.7, "geopolitics": 0.7, "regulation": 0.6, "macro": 0.6, "other": 0.1, "noise": 0.02}


def clean(text: Column) -> Column:
    """Without tags where both angle brackets occur, white space collapsed."""
    bare = F.when(text.contains("<") & text.contains(">"), F.regexp_replace(text, r"<[^<>]*>", " ")).otherwise(text)
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def lexicon_score(text: Column) -> Column:
    """(positive - negative) / both over the words of a text, 3 places; 0 without any."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[а-яё]+"), F.lit(0))
    some = lambda of: F.size(F.filter(words, lambda w: w.isin(*of)))
    up, down = some(POSITIVE), some(NEGATIVE)
    return F.coalesce(F.round((up - down) / F.nullif(up + down, F.lit(0)), 3), F.lit(0.0))


def sentiment(score: Column) -> Column:
    return F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral")


def event_type(text: Column) -> Column:
    """The first class whose rule fits, noise after all others, else other."""
    out = F.lit("other")
    for name, rule in reversed(EVENTS):
        out = F.when(text.rlike(FLAGS + rule), name).otherwise(out)
    return out


def themes(text: Column) -> Column:
    """All themes of a text, in fixed order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(FLAGS + rule), F.lit(name)) for name, rule in THEMES.items()]))


def significance(event: Column, score: Column, relevances: Column | None = None) -> Column:
    """.5 type + .3 |score| + .2 links, each part up to 1, 3 places; an unknown type weighs as other."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv]), event), F.lit(WEIGHT["other"]))
    link = F.least(F.lit(1.0), F.aggregate(F.coalesce(relevances, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)) if relevances is not None else F.lit(0.0)
    raw = 0.5 * w + 0.3 * F.least(F.lit(1.0), F.abs(F.coalesce(score, F.lit(0.0)))) + 0.2 * link
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def bucket(value: Column, low: float = 0.34, high: float = 0.66) -> Column:
    return F.when(value < low, "low").when(value >= high, "high").otherwise("medium")
