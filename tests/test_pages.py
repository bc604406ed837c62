"""Card and schedule pages, name matching and plain text of markup."""

import datetime

import pytest
from pyspark.sql import functions as F

from duelgrid.functions.text import plain_text, stripped
from duelgrid.operators import resolve
from duelgrid.sources import pages


def bout(klass: str, one: str, two: str, notes: str | None = None) -> str:
    fields = [klass, one, "vs.", two] + (["", "", "", notes] if notes is not None else [])
    return "{{MMAevent bout\n|" + "\n|".join(fields) + "\n}}\n"


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id int, text string")


NIGHT = (
    "Intro text with a {{template|of its own}}.\n{{MMAevent card|Top half ([[Channel Nine|Nine]])}}\n"
    + bout("Heavyweight", "[[Olaf Berg (wrestler)|Olaf Berg]] (c)", "'''Tariq  Odeh'''", "Vacant [[Belt|belt]] ''championship''<ref name=a>n</ref>{{efn|x}}")
    + bout("Women's Strawweight", "Mina<ref name=b/> Sato", "[[Ela Kaya]] {{flag|TR}}")
    + "{{MMAevent card|Early bouts}}\n" + bout("Lightweight", "", "Nobody Else") + bout("Lightweight", "José Paz", "Ann <small>O'Hara</small>", "")
)
OTHER = "{{MMAevent card|Only}}\n" + bout("Welterweight", "Uno Two", "Tre Four", "")


def test_bouts_of_two_pages(spark):
    card = pages.card_context(pages.read_cards(table(spark, NIGHT, OTHER))).orderBy("page_id", "section_no", "place").collect()
    shown = [(r["segment"], r["weight_class"], r["entity_1"], r["entity_2"], r["scheduled_rounds"], r["is_title"]) for r in card]
    assert shown == [
        ("Top half (Nine)", "Heavyweight", "Olaf Berg", "Tariq Odeh", 5, True),
        ("Top half (Nine)", "Women's Strawweight", "Mina Sato", "Ela Kaya", 3, False),
        ("Early bouts", "Lightweight", "José Paz", "Ann O'Hara", 3, False),
        ("Only", "Welterweight", "Uno Two", "Tre Four", 5, False),
    ]
    assert [r["notes"] for r in card] == ["Vacant belt championship", "", "", ""]


@pytest.mark.parametrize(
    ("markup", "text"),
    [("a < b [c] {d} (e)", "a < b [c] {d} (e)"), ("[[x|y|z]]'s", "z's"), ("<ref>a [[b]]</ref>c<br/>d", "cd"), ("{{a}}", ""), ("''i'' '''b'''", "i b"),
     ("  p\t q \n", "p q"), ("", ""), (None, None)],
)
def test_plain_text(spark, markup, text):
    df = spark.createDataFrame([(markup,)], "m string")
    assert df.select(plain_text(F.col("m"))).first()[0] == text


def test_white_space_outside_ascii_is_stripped(spark):
    df = spark.createDataFrame([(" Ann \t",), (None,)], "n string")
    assert [r[0] for r in df.select(stripped(F.col("n"))).collect()] == ["Ann", None]


def schedule(*rows: tuple[str, str]) -> str:
    return "heading\n" + "".join(f"|-\n|{name}\n|{date}\n" for name, date in rows)


def test_upcoming_rows(spark):
    text = schedule(
        ("[[Gala 7|Gala 7: North v South]]", "{{dts|2031|January|9}}"), ("[[Gala 8]] at [[Hall]]", "{{dts|2031|Feb|28}}"),
        ("[[Gala 9]]", "{{dts|2031|Feb|30}}"), ("[[Gala 10]]", "soon"),
    )
    def got(today):
        rows = pages.parse_schedules(table(spark, text), F.lit(today).cast("date")).orderBy("event_date").collect()
        return [(r["event"], r["page"], r["event_date"]) for r in rows]

    later = ("Gala 8", "Gala 8", datetime.date(2031, 2, 28))
    assert got("2031-01-09") == [("Gala 7: North v South", "Gala 7", datetime.date(2031, 1, 9)), later]
    assert got("2031-01-10") == [later] and got("2032-01-01") == []


def test_pages_that_cannot_be_read_raise(spark):
    odd = table(spark, schedule(("no link", "{{dts|2031|Feb|1}}")), "{{MMAevent card|X}}\n{{MMAevent bout\n}}\n", "nothing of interest")
    for guard, page in ((pages.schedule_guard(odd), 0), (pages.card_guard(odd), 1)):
        assert [r["page_id"] for r in guard.where("broken").collect()] == [page]
        with pytest.raises(pages.ExtractionBroken):
            pages.require_parsed(guard)
    pages.require_parsed(pages.card_guard(table(spark, NIGHT, OTHER, "")))


def test_a_page_is_read_once_and_nothing_is_exchanged(spark):
    """Bouts, context and guard; NULL texts and repeated pages have rows of their own."""
    odd = spark.createDataFrame([(1, NIGHT), (1, NIGHT), (2, None), (3, "")], "page_id int, text string")
    read = pages.read_cards(odd)
    for df in (pages.parse_cards(odd), pages.card_context(read), pages.extraction_guard(read), pages.schedule_guard(odd)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pages.card_guard(odd).collect())) == [(1, 4, 3, False)] * 2 + [(2, 0, 0, False), (3, 0, 0, False)]
    assert pages.card_context(read).where("page_id = 1 AND scheduled_rounds = 5").count() == 2 and pages.parse_cards(odd).count() == 6


def test_names_find_their_entities(spark):
    entities = spark.createDataFrame(
        [("o", "Olaf Berg", "olafberg", 240.0), ("t", "Tariq Odeh", "tariqodeh", 170.0), ("l1", "Li Na", "lina", 115.0), ("l2", "Li Na", "lina", 155.0),
         ("l3", "Li Na", "lina", None)],
        "entity_id string, name string, name_norm string, listed_weight_lbs double",
    )
    seen = spark.createDataFrame([("l1", "Strawweight"), ("l2", "Lightweight")], "entity_id string, last_weight_class string")
    asked = [("Ólaf Berg", "Heavyweight"), ("Tariq Odeh Jr.", "Welterweight"), ("Xi Yu", "Flyweight"), ("Li Na", "Lightweight"), ("Li Na", "Flyweight"), ("Li Na", "Open")]
    found = resolve.match_mentions(spark.createDataFrame(asked, "name string, weight_class string"), entities, seen)
    got = {(r["name"], r["weight_class"]): (r["entity_id"], r["how"].rpartition("picked ")[2]) for r in found.collect()}
    assert [got[a][0] for a in asked] == ["o", "t", "new_xiyu", "l2", "l1", "l1"]
    assert [got[a][1] for a in asked[3:]] == ["by division)", "by weight)", "matched (ambiguous name)"]
