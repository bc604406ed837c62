"""Records out of templated page text, as jobs over a page table.

A page is cut at its section markers first, so every record knows its section from the piece it
lies in: one narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.constants import MONTHS
from duelgrid.functions.text import plain_text

# The page templates that hold a card's sections, its bouts and a row's date.
SECTION_TEMPLATE = "MMAevent card"
BOUT_TEMPLATE = "MMAevent bout"
DATE_TEMPLATE = "dts"
INSIDE = r"(?:[^{}]++|\{\{[^{}]*+\}\}|\{(?!\{)|\}(?!\}))*+"  # text of a template, templates in it included
BOUT_FIELDS = 8


def sections(pages: DataFrame, page_id: str, text: Column, marker: str) -> DataFrame:
    """Pieces of each page that follow a `marker` (regex); piece 0 precedes the first marker."""
    return pages.select(
        page_id, F.posexplode(F.split(text, marker)).alias("section_no", "piece")
    )


def extract_records(
    pages: DataFrame, page_id: str, text: Column, section_marker: str, section_title: str, record: str
) -> DataFrame:
    """Every match of `record` (regex, group 1) with its page, section title and place.

    `section_title` (regex, group 1) is read at the start of each piece.
    """
    pieces = sections(pages, page_id, text, section_marker)
    first = F.col("section_no") == 0
    title = F.when(~first, F.regexp_extract("piece", section_title, 1)).otherwise("")
    return pieces.select(
        page_id,
        "section_no",
        title.alias("section"),
        F.posexplode(F.regexp_extract_all("piece", F.lit(record), F.lit(1))).alias("place", "record"),
    )


def _card_bouts(text: Column) -> Column:
    """All bouts of a page in page order, in one array; fields that are missing at the end read as ''."""
    bout = r"\{\{" + BOUT_TEMPLATE + r"\s*+\|(" + INSIDE + r")\}\}"
    field_text = r"(?:\A|\n\|)((?:(?!\n\|)[\s\S])*+)"  # up to the next line that opens with a bar

    def section(piece: Column, number: Column) -> Column:
        linked = F.regexp_extract(piece, "^(" + INSIDE + r")\}\}", 1)
        title = F.when(number > 0, F.trim(F.get(F.split(plain_text(linked), r"\|"), 0))).otherwise("")
        bodies = F.transform(
            F.regexp_extract_all(piece, F.lit(bout), F.lit(1)),
            lambda body: F.regexp_extract_all(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(field_text), F.lit(1)),
        )
        return F.struct(number.alias("section_no"), title.alias("segment"), bodies.alias("bodies"))

    def bouts_of(held: Column) -> Column:
        def read(fields: Column, place: Column) -> Column:
            def field(i: int) -> Column:
                return plain_text(F.coalesce(F.get(fields, F.lit(i - 1)), F.lit("")))

            return F.struct(
                held["section_no"].alias("section_no"), place.alias("place"), held["segment"].alias("segment"),
                field(1).alias("weight_class"), field(2).alias("entity_1"), field(4).alias("entity_2"),
                field(BOUT_FIELDS).alias("notes"),
            )

        return F.transform(held["bodies"], read)

    pieces = F.split(text, r"\{\{" + SECTION_TEMPLATE + r"\s*\|")
    found = F.flatten(F.transform(F.transform(pieces, section), bouts_of))
    return F.filter(found, lambda b: (b["entity_1"] != "") & (b["entity_2"] != ""))


def read_cards(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """One row per page: bout markers seen (n_markers) and the bouts read (`records`, in page order).

    Guard, bouts and context all come from these rows, so a page is parsed once and nothing is exchanged. A NULL text
    has neither markers nor records.
    """
    return _read(pages, page_id, text, r"\{\{" + BOUT_TEMPLATE, _card_bouts)


def _read(pages: DataFrame, page_id: str, text: str, marker: str, records: Callable[[Column], Column]) -> DataFrame:
    given = F.coalesce(F.col(text), F.lit(""))
    return pages.select(page_id, (F.size(F.split(given, marker)) - 1).alias("n_markers"), records(given).alias("records"))


def parse_cards(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """Bouts of card pages in page order."""
    rows = read_cards(pages, page_id, text).select(page_id, F.inline("records"))
    return rows.select(page_id, "section_no", "place", "segment", "weight_class", "entity_1", "entity_2", "notes")


def card_context(cards: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Bouts of `read_cards` with a title flag from the notes; five rounds for a title bout and for a page's first bout."""
    rows = cards.select(page_id, F.posexplode("records").alias("nth", "bout")).select(page_id, "nth", "bout.*")
    title = F.lower("notes").contains("championship")
    return rows.select(
        page_id, "section_no", "place", "segment", "weight_class", "entity_1", "entity_2", "notes",
        title.alias("is_title"),
        F.when(title | (F.col("nth") == 0), 5).otherwise(3).alias("scheduled_rounds"),
    )


def _schedule_rows(text: Column) -> Column:
    """All dated, linked rows of a page, in one array."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])

    def parts(row: Column, number: Column) -> Column:
        opened = F.regexp_extract(row, r"\[\[([^\[\]]++)\]\]", 1)  # the first link: page, then maybe a bar and its label
        dated = F.split(F.regexp_extract(row, r"\{\{" + DATE_TEMPLATE + r"\|([^{}]++)\}\}", 1), r"\|")
        return F.struct(number.alias("row_no"), opened.alias("opened"), dated.alias("dated"))

    def read(p: Column) -> Column:
        page = F.nullif(F.substring_index(p["opened"], "|", 1), F.lit(""))
        label = F.nullif(F.substring(p["opened"], F.length(page) + 2, F.lit(1 << 30)), F.lit(""))
        year, month, day = (F.trim(F.get(p["dated"], i)) for i in range(3))
        when = F.try_make_timestamp(
            year.try_cast("int"), F.try_element_at(months, F.substring(month, 1, 3)), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)
        ).cast("date")
        return F.struct(
            p["row_no"].alias("row_no"), F.trim(F.coalesce(label, page)).alias("event"), F.trim(page).alias("page"), when.alias("event_date")
        )

    rows = F.filter(F.transform(F.split(text, r"\|-"), parts), lambda p: p["row_no"] > 0)
    return F.filter(F.transform(rows, read), lambda r: r["page"].isNotNull() & r["event_date"].isNotNull())


def read_schedules(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """One row per page: date markers seen (n_markers) and the rows read (`records`)."""
    return _read(pages, page_id, text, r"\{\{" + DATE_TEMPLATE + r"\|", _schedule_rows)


def parse_schedules(pages: DataFrame, today: Column, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """Scheduled rows on or after `today`; order by event_date for soonest first."""
    return read_schedules(pages, page_id, text).select(page_id, F.inline("records")).filter(F.col("event_date") >= today)


def extraction_guard(read: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Per page: markers seen, records read, and whether markers were seen but nothing was read."""
    n = F.size("records").cast("long")
    return read.select(page_id, "n_markers", n.alias("n_records"), ((F.col("n_markers") > 0) & (n == 0)).alias("broken"))


def schedule_guard(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """A page whose rows are all in the past is fine: past rows count as read."""
    return extraction_guard(read_schedules(pages, page_id, text), page_id)


def card_guard(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    return extraction_guard(read_cards(pages, page_id, text), page_id)


class ExtractionBroken(RuntimeError):
    """Pages hold the expected markers but nothing could be read from them."""


def require_parsed(guard: DataFrame, page_id: str = "page_id") -> None:
    bad = [r[0] for r in guard.filter("broken").select(page_id).limit(5).collect()]
    if bad:
        raise ExtractionBroken(f"markers without records, first pages: {bad}")
