"""Payloads of public feeds, as strings in a column, to typed rows: Spark's own JSON and XML parsers and column expressions.

Every function takes a DataFrame with an id and a payload column and keeps the id. A payload that cannot be parsed gives no rows, a
record with a missing or broken field is left out and the others stay; nulls and empty payloads give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import MULTIPLIER

# Codes of metals, fields of a yearly report (our name and how its cells are read), words of currencies.
METALS = {"1": "gold", "2": "silver", "3": "platinum", "4": "palladium"}
REPORT_FIELDS = {
    "revenue": ("revenue", "money"), "net_income": ("net_profit", "money"), "ebitda": ("ebitda", "money"), "operating_income": ("operating_income", "money"), "ocf": ("ocf", "money"), "fcf": ("fcf", "money"),
    "capex": ("capex", "money"), "assets": ("assets", "money"), "bank_assets": ("assets", "money"), "net_assets": ("equity", "money"), "capital": ("equity", "money"), "debt": ("debt", "money"),
    "net_debt": ("net_debt", "money"), "market_cap": ("market_cap", "money"), "ev": ("ev", "money"), "eps": ("eps", "share"), "dividend": ("dividend", "share"), "p_e": ("pe", "ratio"), "p_b": ("pb", "ratio"),
    "roe": ("roe", "pct"), "roa": ("roa", "pct"), "div_yield": ("div_yield", "pct"), "div_payout_ratio": ("payout", "pct"), "free_float": ("free_float", "pct"),
}
CURRENCIES = {"руб": "RUB", "долл": "USD", "$": "USD", "евро": "EUR", "юан": "CNY"}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&laquo;": "«", "&raquo;": "»", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def _number(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")


def _day(raw: Column) -> Column:
    """A date dd.mm.yyyy."""
    ok = raw.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$")
    two = lambda i: F.lpad(F.split_part(raw, F.lit("."), F.lit(i)), 2, "0")
    return F.when(ok, F.concat_ws("-", F.split_part(raw, F.lit("."), F.lit(3)), two(2), two(1)).try_cast("date"))


# Patterns of a well-formed XML text; names of end tags need no look, as they fit. ITEM: a text, a comment or an element of up to three levels.
_ATT = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_OPEN, _SELF, _CLOSE = rf"<[^!?/<>]{_ATT}(?<!/)>", rf"<[^!?/<>]{_ATT}(?<=/)>", "</[^>]*>"
_MISC = r"[^<]++|<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>"
_LEAF = rf"{_SELF}|{_OPEN}(?:{_MISC})*+{_CLOSE}"
_MID = rf"{_SELF}|{_OPEN}(?:{_MISC}|{_LEAF})*+{_CLOSE}"
_ITEM = rf"(?>{_MISC}|{_SELF}|{_OPEN}(?:{_MISC}|{_MID})*+{_CLOSE})"
_HEAD = rf"\A(?:[^<]++|<\?[\s\S]*?\?>|<!--[\s\S]*?-->)*+{_OPEN}"
#: Items of a piece of an XML text, and characters of a text that is parsed whole.
PIECE, LONG = 200, 1 << 16


def _pieces(payloads: DataFrame, id: str, payload: str) -> DataFrame:
    """(id, piece): long well-formed XML texts in texts of up to PIECE items of their root, each with the whole root tag. Spark's parser copies all
    records found so far for each new one, so one long text takes the square of its length. A short text, one of deeper elements, or one with a
    document type stays in one piece."""
    text, long = F.nullif(F.col(payload), F.lit("")), F.length("_text") > LONG
    d = payloads.select(id, text.alias("_text"))
    d = d.select(id, "_text", F.when(long, F.from_xml("_text", "_none string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()).otherwise(False).alias("_bad"), F.when(long, F.regexp_extract("_text", f"({_HEAD})", 1)).alias("_head"))
    items = F.when(~F.col("_bad") & (F.col("_head") != ""), F.regexp_extract_all("_text", F.lit(rf"(?:{_HEAD}|\G(?!\A))((?:{_ITEM}){{1,{PIECE}}}+)"), F.lit(1)))
    d = d.select(id, "_text", "_bad", "_head", items.alias("_items"))
    end = F.length("_head") + F.aggregate("_items", F.lit(0), lambda n, x: n + F.length(x))
    tail = F.concat(F.lit("</"), F.regexp_extract("_head", r"<([^!?/\s<>][^\s<>/]*)[^<]*\z", 1), F.lit(">"))
    whole = F.col("_items").isNotNull() & (F.substring("_text", end + 1, F.lit(2)) == "</")
    d = d.select(id, "_head", tail.alias("_tail"), "_items", F.when(~F.col("_bad"), F.col("_text")).alias("_text"), F.coalesce(whole, F.lit(False)).alias("_cut"))
    d = d.select(id, "_head", "_tail", "_cut", F.explode_outer(F.when(F.col("_cut"), F.col("_items")).otherwise(F.array("_text"))).alias("_piece"))  # outer: else the array is made again for a filter before it
    return d.select(id, F.when(F.col("_cut"), F.concat("_head", "_piece", "_tail")).otherwise(F.col("_piece")).alias("piece"))


def _records(payloads: DataFrame, id: str, payload: str, fields: str) -> DataFrame:
    schema = f"Record array<struct<_Date: string, _Code: string, _Id: string, {fields}: string>>"
    d = _pieces(payloads, id, payload).select(id, F.from_xml("piece", schema, {"mode": "PERMISSIVE"})["Record"].alias("x"))
    return d.select(id, F.explode_outer("x").alias("r"))


def fx_rates(payloads: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, d, value): the rate of one unit on each date of an XML list of records (attribute Date, element VunitRate, decimal comma)."""
    r = _records(payloads, id, payload, "VunitRate")
    return r.select(id, _day(F.col("r._Date")).alias("d"), _number(F.col("r.VunitRate")).alias("value")).where("d is not null and value is not null")


def metal_prices(payloads: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, indicator, d, value): the selling price of each metal and date of an XML list of records (Date, Code, element Sell); unknown codes are left out."""
    r = _records(payloads, id, payload, "Sell")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in METALS.items() for x in kv]), F.col("r._Code"))
    return r.select(id, name.alias("indicator"), _day(F.col("r._Date")).alias("d"), _number(F.col("r.Sell")).alias("value")).where("indicator is not null and d is not null and value is not null")


def observations(payloads: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, d, value) of a JSON object with observations [{date, value}, ...]; a value of "." is a gap."""
    x = F.from_json(payload, "observations array<struct<date: string, value: string>>")
    d = payloads.select(id, F.explode(x["observations"]).alias("o"))
    good = F.when(F.col("o.date").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.col("o.date").try_cast("date"))
    return d.select(id, good.alias("d"), F.col("o.value").try_cast("double").alias("value")).where("d is not null and value is not null")


def depth(payloads: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, best_bid, best_ask, spread, bid_vol, ask_vol, imbalance, levels) of a JSON object whose marketdata is a table {columns, data}.

    The first row of data counts. A missing spread is that of the best prices; imbalance is (bid - ask) / (bid + ask) of the volumes where they
    are above 0. A payload without any of the first five gives no row."""
    d = payloads.select(id, F.from_json(payload, "marketdata struct<columns: array<string>, data: array<array<string>>>")["marketdata"].alias("m"))
    cell = lambda c: F.get(F.get("m.data", F.lit(0)), F.array_position("m.columns", F.lit(c)).cast("int") - 1).try_cast("double")
    d = d.select(id, *[cell(c).alias(n) for n, c in (("best_bid", "BID"), ("best_ask", "OFFER"), ("_spread", "SPREAD"), ("bid_vol", "BIDDEPTHT"), ("ask_vol", "OFFERDEPTHT"), ("_levels", "NUMBIDS"))])
    d = d.where("coalesce(best_bid, best_ask, _spread, bid_vol, ask_vol) is not null")
    both = F.col("bid_vol") + F.col("ask_vol")
    return d.select(id, "best_bid", "best_ask", F.coalesce("_spread", F.col("best_ask") - F.col("best_bid")).alias("spread"), "bid_vol", "ask_vol", F.when(both > 0, (F.col("bid_vol") - F.col("ask_vol")) / both).alias("imbalance"), F.col("_levels").cast("int").alias("levels"))


def unescaped(text: Column) -> Column:
    """Without the entities of HTML: decimal ones, and those named in ENTITIES."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7});"), F.lit(1)))
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32")
    out = F.aggregate(codes, text, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), letter(c)))
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def channel_posts(pages: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, post_id, text, published) of the posts of a channel's preview page: each from its data-post on to the next; line breaks
    are kept, tags go; posts without text are left out; a time that cannot be read is null."""
    post = r'data-post="([^"]+)"([\s\S]*?)(?=data-post="|\z)'
    got = [F.regexp_extract_all(payload, F.lit(post), F.lit(i)) for i in (1, 2)]
    d = pages.where(F.col(payload).isNotNull()).select(id, F.explode(F.arrays_zip(got[0].alias("post_id"), got[1].alias("block"))).alias("p"))
    raw = F.regexp_extract("p.block", r"tgme_widget_message_text[^>]*>([\s\S]*?)</div>", 1)
    text = F.regexp_replace(F.regexp_replace(raw, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    time = F.regexp_extract("p.block", r'<time[^>]*datetime="([^"]+)"', 1)
    d = d.select(id, F.col("p.post_id").alias("post_id"), F.regexp_replace(unescaped(text), r"(?U)^\s+|\s+\z", "").alias("text"), F.try_to_timestamp(F.when(time != "", time)).alias("published"))
    return d.where("text != ''")


def _text(cell: Column) -> Column:
    return F.regexp_replace(unescaped(F.regexp_replace(cell, "<[^>]+>", "")), r"(?U)^\s+|\s+\z", "")


def yearly_reports(pages: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, metric, value, unit, period) of the first table of more than five rows of a page of yearly reports, and the margins that follow from it.

    The columns are those of the first row with two or more years among its cells; rows are told by their field attribute; money is scaled by
    the unit in the row's heading. Cells of charts do not count as columns; empty cells, dashes and words are left out."""
    table = F.filter(F.regexp_extract_all(payload, F.lit(r"<table[^>]*>[\s\S]*?</table>"), F.lit(0)), lambda t: F.size(F.regexp_extract_all(t, F.lit(r"<tr[\s>]"), F.lit(0))) > 5)
    d = pages.where(F.col(payload).isNotNull()).select(id, F.get(table, F.lit(0)).alias("t")).where("t is not null")
    d = d.select(id, F.posexplode(F.regexp_extract_all("t", F.lit(r"<tr(?:\s[^>]*)?>[\s\S]*?(?=<tr[\s>]|</table>)"), F.lit(0))).alias("at", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"<td(?![^>]*chartrow)[^>]*>([\s\S]*?)(?=</td>|<td[\s>]|\z)"), F.lit(1)), _text)
    d = d.select(id, "at", F.regexp_extract("row", r'^<tr[^>]*\sfield="([^"]*)"', 1).alias("field"), _text(F.regexp_extract("row", r"<th[\s>][\s\S]*?<span[^>]*>([\s\S]*?)</span>", 1)).alias("unit"), cells.alias("cells"))
    years = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), c.alias("year"))), lambda c: c["year"].rlike("^(?:19|20)[0-9]{2}$"))
    heads = d.where(F.size(years) >= 2).groupBy(id).agg(F.min_by(years, "at").alias("years"))
    kinds = F.create_map(*[x for f, (m, k) in REPORT_FIELDS.items() for x in (F.lit(f), F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind")))])
    d = d.where(F.col("field").isin(*REPORT_FIELDS)).withColumn("of", F.element_at(kinds, F.col("field"))).join(heads, id)
    d = d.select(id, "at", "of.metric", "of.kind", F.lower("unit").alias("unit"), "cells", F.explode("years").alias("y")).select(id, "at", "metric", "kind", "unit", F.col("y.year").alias("period"), F.get("cells", F.col("y.i")).alias("raw"))
    value = F.replace(F.replace(F.regexp_replace("raw", r"(?U)\s+", ""), F.lit("%"), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    scale, currency = F.lit(1.0), F.lit("RUB")
    for word, x in reversed(MULTIPLIER.items()):
        scale = F.when(F.contains("unit", F.lit(word)), x).otherwise(scale)
    for word, x in reversed(CURRENCIES.items()):
        currency = F.when(F.contains("unit", F.lit(word)), x).otherwise(currency)
    kind = F.col("kind")
    d = d.select(id, "at", "metric", F.when(kind == "money", value * scale).otherwise(value).alias("value"), F.when(kind.isin("pct", "ratio"), kind).otherwise(currency).alias("unit"), "period").where("value is not null")
    of = lambda m: F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("at")))
    m = d.groupBy(id, "period").agg(of("revenue").alias("r"), of("net_profit").alias("p"), of("ebitda").alias("e")).where("r != 0")
    share = lambda name, c: F.struct(F.lit(name).alias("metric"), F.round(F.col(c) / F.col("r") * 100, 2).alias("value"))
    m = m.select(id, "period", F.explode(F.array(share("net_margin", "p"), share("ebitda_margin", "e"))).alias("x")).where("x.value is not null")
    return d.select(id, "metric", "value", "unit", "period").unionByName(m.select(id, "x.metric", "x.value", F.lit("pct").alias("unit"), "period"))
