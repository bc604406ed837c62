"""Small tables made from short descriptions of bouts."""

from __future__ import annotations

import datetime
import random
from collections import namedtuple

STATS = ["sig_landed", "sig_att", "opp_sig_landed", "opp_sig_att", "td_landed", "td_att", "opp_td_landed",
         "opp_td_att", "sub_att", "kd", "opp_kd", "ctrl_s"]
SCHEMA = ("bout_id string, entity_id string, event_date date, result string, method string, duration_s double, has_stats boolean, "
          + ", ".join(f"{c} double" for c in STATS))
ENTITY_SCHEMA = "entity_id string, name string, dob date, height_in double, reach_in double, stance string"
Bout = namedtuple("Bout", "id date one first two second method landed")  # landed: strikes of either side
TURNED = {"W": "L", "L": "W", "D": "D", "NC": "NC", "NA": "NA"}


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def pairings(text: str, method: str = "DEC") -> list[Bout]:
    """`date one RESULT two` entries between semicolons; the result is the first side's."""
    parts = [p.split() for p in text.split(";")]
    return [Bout(f"b{i:04d}", day(d), a, r, b, TURNED[r], method, (25 + i, 18)) for i, (d, a, r, b) in enumerate(parts)]


def calendar_of(seed: int, bouts: int = 150, dates: int = 24, people: int = 7) -> list[Bout]:
    """Random bouts on few dates, so that people meet several times a day, with every kind of result."""
    rng = random.Random(seed)
    held = [day("2016-05-14") + datetime.timedelta(days=sum(rng.choices([7, 14, 28], k=i))) for i in range(dates)]
    out = []
    for i in range(bouts):
        one, two = rng.sample([f"p{k}" for k in range(people)], 2)
        result = rng.choices(list(TURNED), [5, 3, 1, 1, 1])[0]
        landed = (rng.randint(0, 80), rng.randint(0, 80))
        out.append(Bout(f"b{i:04d}", rng.choice(held), one, result, two, TURNED[result], rng.choice(["SUB", "DEC", "KO/TKO"]), landed))
    return out


def appearances_of(spark, bouts: list[Bout]):
    """Both rows of every bout; quantities other than strikes are zero, a bout lasts a quarter of an hour."""
    rows = []
    for b in bouts:
        for who, result, own, other in ((b.one, b.first, *b.landed), (b.two, b.second, *reversed(b.landed))):
            stats = {c: 0.0 for c in STATS} | {"sig_landed": float(own), "sig_att": 3.0 * own, "opp_sig_landed": float(other), "opp_sig_att": 3.0 * other}
            rows.append((b.id, who, b.date, result, b.method, 900.0, True, *stats.values()))
    return spark.createDataFrame(rows, SCHEMA)


def people_of(spark, ids):
    """Entities born in different years, of different size; odd ones have no reach."""
    rows = [(i, f"Name {i}", datetime.date(1980 + n, 6, 1), 64.0 + n, None if n % 2 else 66.0 + n, "Southpaw" if n % 3 == 0 else "Orthodox") for n, i in enumerate(sorted(ids))]
    return spark.createDataFrame(rows, ENTITY_SCHEMA)
