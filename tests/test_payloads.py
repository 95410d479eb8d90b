"""Payloads with good, broken and missing records."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tessera.plans import payloads as plans
from tessera.sources import payloads as pl

FX = '<?xml version="1.0" encoding="windows-1251"?><ValCurs ID="R01235"><Record Date="12.01.2026" Id="R01235"><Nominal>10</Nominal><Value>112,34</Value><VunitRate>11,234</VunitRate></Record><Record Date="13.01.2026" Id="R01235"><VunitRate>bad</VunitRate></Record><Record Date="31.02.2026"><VunitRate>1,5</VunitRate></Record><Record Date="14.01.2026"></Record><Record><VunitRate>2</VunitRate></Record><Record Date="15.01.2026"><VunitRate>12</VunitRate></Record></ValCurs>'
METAL = '<Metall><Record Date="12.01.2026" Code="1"><Buy>1</Buy><Sell>9001,5</Sell></Record><Record Date="12.01.2026" Code="9"><Sell>1</Sell></Record><Record Date="12.01.2026" Code="2"><Sell>101,25</Sell></Record></Metall>'
FRED = '{"count": 4, "observations": [{"date": "2026-01-12", "value": "71.5"}, {"date": "2026-01-13", "value": "."}, {"date": "x", "value": "1"}, {"date": "2026-02-30", "value": "1"}, {"value": "3"}, {"date": "2026-01-14", "value": ""}]}'
HTML = """<div class="x" data-post="chan/1"><div class="tgme_widget_message_text js" dir="auto">First &amp; <b>bold</b><br/>line &#1090;&#128512; &laquo;q&raquo;</div><time datetime="2026-06-10T12:00:00+03:00" class="time"></time></div>
<div data-post="chan/2"><div class="photo"></div></div><div data-post="chan/3"><div class="tgme_widget_message_text">  &nbsp; </div></div><div data-post="chan/4"><div class="tgme_widget_message_text">Last</div><time datetime="soon"></time></div>"""
REPORT = """<table><tr><td>small</td></tr></table><table class="f"><tr class="header_row"><th>x</th><td class="chartrow"></td><td>2023</td><td>2024</td><td>LTM</td></tr>
<tr field="revenue"><th><a>Выручка</a><span> млрд руб </span></th><td class="chartrow"><i></i></td><td><strong>1 234,5</strong></td><td>1&nbsp;000</td><td>9</td></tr>
<tr field="net_income"><th>x<span>млрд руб</span></th><td class="chartrow"></td><td>-</td><td>250</td><td>1</td></tr><tr field="ebitda"><th><span>млн долл</span></th><td>500</td><td></td></tr>
<tr field="eps"><th><span>руб/акцию</span></th><td>12,5</td><td>нет</td></tr><tr field="roe"><th><span>%</span></th><td>15,1%</td><td>16%</td></tr><tr field="other"><td>1</td><td>2</td></tr><tr field="p_e"><th></th><td>5.5</td></tr></table>"""
BAD = ["", None, "<broken", "{", "[]"]


def frame(spark, *good):
    return spark.createDataFrame(list(enumerate([*good, *BAD])), "id int, payload string").repartition(2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_xml(spark):
    assert rows(pl.fx_rates(frame(spark, FX))) == [(0, date(2026, 1, 12), 11.234), (0, date(2026, 1, 15), 12.0)]
    assert rows(pl.metal_prices(frame(spark, METAL, FX))) == [(0, "gold", date(2026, 1, 12), 9001.5), (0, "silver", date(2026, 1, 12), 101.25)]
    assert rows(pl.fx_rates(frame(spark, '<ValCurs><Record Date="1.2.2026"><VunitRate>3</VunitRate></Record></ValCurs>'))) == [(0, date(2026, 2, 1), 3.0)]


def test_json(spark):
    assert rows(pl.observations(frame(spark, FRED, '{"observations": []}'))) == [(0, date(2026, 1, 12), 71.5)]
    head = '{"marketdata": {"columns": ["SECID", "BID", "OFFER", "SPREAD", "NUMBIDS", "BIDDEPTHT", "OFFERDEPTHT"], "data": '
    df = frame(spark, head + '[["X", 10.5, 11, null, 7, 30, 10], ["Y", 1, 1, 1, 1, 1, 1]]}}', head + '[["X", null, null, 0.5, null, null, null]]}}', head + '[["X", null, null, null, 3, null, null]]}}', head + "[]}}", '{"marketdata": {"columns": ["OFFER"], "data": [["x"]]}}')
    assert rows(pl.depth(df)) == [(0, 10.5, 11.0, 0.5, 30.0, 10.0, 0.5, 7), (1, None, None, 0.5, None, None, None, None)]


def test_posts(spark):
    got = rows(pl.channel_posts(frame(spark, HTML)))
    assert got == [(0, "chan/1", "First & bold\nline т😀 «q»", datetime(2026, 6, 10, 9)), (0, "chan/4", "Last", None)]


def test_yearly_reports(spark):
    got = rows(pl.yearly_reports(frame(spark, REPORT, "<table></table>")))
    want = [
        (0, "ebitda", 500e6, "USD", "2023"), (0, "ebitda_margin", 0.04, "pct", "2023"), (0, "eps", 12.5, "RUB", "2023"), (0, "net_margin", 25.0, "pct", "2024"), (0, "net_profit", 250e9, "RUB", "2024"), (0, "pe", 5.5, "ratio", "2023"),
        (0, "revenue", 1e12, "RUB", "2024"), (0, "revenue", 1234.5e9, "RUB", "2023"), (0, "roe", 15.1, "pct", "2023"), (0, "roe", 16.0, "pct", "2024"),
    ]
    assert got == sorted(want, key=str)


def whole(df, fields):
    """The records by one parse of each whole text."""
    schema = f"Record array<struct<_Date: string, _Code: string, _Id: string, {fields}: string>>"
    return df.where("payload != ''").select("id", F.explode(F.from_xml("payload", schema, {"mode": "PERMISSIVE"})["Record"]).alias("r"))


def metal(i):
    return f'<Record Date="{i % 28 + 1}.01.2026" Code="{i % 6}"><Buy>1</Buy><Sell>{i},5</Sell></Record>'


ODD = ["<V/>", "<V></V>", "text", "<V>{0}", "<V>{0}</V>tail", "<V>{0}</V><V>{1}</V>", "<V>{0}<Record></V>", '<V><!-- <Record Date="9"> -->{0}<![CDATA[<Record Date="8"/>]]>text {1}</V>', "<V><X>{0}</X>{1}</V>", "<V>{0}<a><b><c><d>1</d></c></b></a>{1}</V>",
       '<?xml version="1.0"?><!-- <V> --><v:V xmlns:v="u" a="b>c"><v:Record Code="1"/>{0}</v:V >', "<!DOCTYPE V><V>{0}</V>", "<V>{0}&bad;</V>", "<V>{0}<Record a='1' a='2'/></V>", "  <V\n>{0}\n<?p <x> ?><Record Date=\"/>\"/>{1}</V>", '<V><record Date="1.1.2026" Code="2"><sell>1</sell></record>{1}</V>', "<Record>{1}</Record>"]


def test_xml_in_pieces(spark):
    """A long text is parsed in pieces of few records, and gives what one parse gives; so do odd ones."""
    many = "".join(metal(i) + " \n" * (i % 2) for i in range(1, 1002))
    df = frame(spark, f"<Metall>{many}</Metall>", f"<Metall>{many}", f"<Metall><!-- x -->{many}<a><b><c><d/></c></b></a></Metall>", *(x.replace("{0}", metal(1)).replace("{1}", metal(2)) for x in ODD))
    parts = pl._pieces(df, "id", "payload").where("piece is not null")
    assert parts.where("id = 0").count() > 5 and parts.where("id <> 2").agg(F.max(F.size(F.regexp_extract_all("piece", F.lit("<Record"), F.lit(0))))).first()[0] <= pl.PIECE
    got = rows(pl._records(df, "id", "payload", "Sell").where("r is not null"))
    assert len(got) > 2002 and got == rows(whole(df, "Sell"))
    assert {r.id: r.n for r in pl.metal_prices(df).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect() if r.id < 3} == {0: 668, 2: 668}


def test_odd_xml_that_is_long(spark):
    """Texts beyond LONG, odd ones too, give what one parse gives."""
    many = "".join(metal(i) for i in range(1, 1002))
    df = frame(spark, *(x.replace("{0}", metal(1)).replace("{1}", metal(2) + many) for x in ODD), *(x.replace("{0}", many) for x in ODD))
    got = rows(pl._records(df, "id", "payload", "Sell").where("r is not null"))
    assert len(got) > 12 * 1001 and got == rows(whole(df, "Sell"))


def test_payloads_of_stretches(spark):
    """No payload holds all of a key; together they hold every record once."""
    d = spark.range(50000).selectExpr("id", "if(id % 9 = 0, null, concat('<r>', id, '</r>')) as r")
    got = plans._joined(d, "id % 2", "id", "r", "<v>", "</v>", "\n").collect()
    assert len(got) == 8 and max(r.payload.count("<r>") for r in got) <= plans.STRETCH / 2
    assert sorted(x for r in got for x in r.payload[3:-4].split("\n")) == sorted(f"<r>{i}</r>" for i in range(50000) if i % 9)
