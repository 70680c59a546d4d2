"""Opening hours as column expressions: open now, today's hours, next opening, and the run of open days.

Two inputs: ``periods`` (array of open/close structs with day 0 = Sunday, hour, minute) and ``lines`` (weekday texts
such as "Monday: 10:00 AM – 8:00 PM"). ``at`` is the viewer's local time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions.text import let

WEEK_MINUTES = 7 * 1440


def clock(hour: Column, minute: Column) -> Column:
    """Hour and minute as "10:05 AM"."""
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    half = F.when(hour >= 12, F.lit("PM")).otherwise(F.lit("AM"))
    return F.concat(twelve.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(" "), half)


def _day_name(day: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in cat.DAY_NAMES]), day)


def _now(at: Column) -> tuple[Column, Column]:
    return F.dayofweek(at) - 1, F.hour(at) * 60 + F.minute(at)


def valid_periods(periods: Column) -> Column:
    """Periods whose open and close are both complete and in range; null if none is left."""
    def ok(t: Column) -> Column:
        return F.coalesce(
            t["day"].between(0, 6) & t["hour"].between(0, 23) & t["minute"].between(0, 59), F.lit(False)
        )

    kept = F.filter(periods, lambda p: ok(p["open"]) & ok(p["close"]))
    return F.when(F.size(kept) > 0, kept)


def status_from_periods(periods: Column, at: Column) -> Column:
    """Struct (is_open, today_hours, next_open). A period that opens and closes at the same time counts as closed."""
    day, minute = _now(at)
    opens = lambda p: p["open"]["hour"] * 60 + p["open"]["minute"]
    closes = lambda p: p["close"]["hour"] * 60 + p["close"]["minute"]

    def covers(p: Column) -> Column:
        same_day = p["open"]["day"] == p["close"]["day"]
        within = (p["open"]["day"] == day) & (minute >= opens(p)) & (minute < closes(p))
        overnight = ((p["open"]["day"] == day) & (minute >= opens(p))) | (
            (p["close"]["day"] == day) & (minute < closes(p))
        )
        return F.when(same_day, within).otherwise(overnight)

    is_open = F.exists(periods, covers)
    def span(today: Column) -> Column:
        return F.when(
            today.isNotNull(),
            F.concat(
                clock(today["open"]["hour"], today["open"]["minute"]), F.lit(" – "),
                clock(today["close"]["hour"], today["close"]["minute"]),
            ),
        ).otherwise("Closed")

    today_hours = let(F.get(F.filter(periods, lambda p: p["open"]["day"] == day), F.lit(0)), span)

    def wait(p: Column) -> Column:
        ahead = F.pmod(p["open"]["day"] - day, F.lit(7)) * 1440 + opens(p) - minute
        ahead = F.when(ahead <= 0, ahead + WEEK_MINUTES).otherwise(ahead)
        return F.struct(ahead.alias("wait"), p["open"].alias("open"))

    def soonest(waits: Column) -> Column:
        least = F.array_min(F.transform(waits, lambda w: w["wait"]))
        return F.get(F.filter(waits, lambda w: w["wait"] == least), F.lit(0))["open"]

    def label(first: Column) -> Column:
        at_text = clock(first["hour"], first["minute"])
        later_today = (first["day"] == day) & (first["hour"] * 60 + first["minute"] > minute)
        return F.when(later_today, F.concat(F.lit("Opens at "), at_text)).otherwise(
            F.concat(F.lit("Opens "), _day_name(first["day"]), F.lit(" at "), at_text)
        )

    waits = F.filter(F.transform(periods, wait), lambda w: w["wait"] < WEEK_MINUTES)
    next_open = let(let(waits, soonest), label)
    return let(is_open, lambda o: F.struct(
        o.alias("is_open"), today_hours.alias("today_hours"), F.when(~o, next_open).alias("next_open")
    ))


def _line_for(lines: Column, name: Column) -> Column:
    return F.get(F.filter(lines, lambda x: x.startswith(name)), F.lit(0))


def _after_colon(line: Column) -> Column:
    return F.when(F.instr(line, ":") > 0, F.trim(F.regexp_extract(line, r"^[^:]*:((?s).*)$", 1)))


def status_from_lines(lines: Column, at: Column) -> Column:
    """The same struct from weekday texts: today's line, its AM/PM range, and the next day that is not closed."""
    day, minute = _now(at)
    today = _after_colon(_line_for(lines, _day_name(day)))
    times = r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)"
    grab = lambda i: F.regexp_extract_all(today, F.lit(times), F.lit(i))
    hours, minutes, halves = grab(1), grab(2), grab(3)

    def at_index(i: int) -> Column:
        h, half = F.get(hours, F.lit(i)).cast("int"), F.upper(F.get(halves, F.lit(i)))
        h = F.when((half == "PM") & (h != 12), h + 12).when((half == "AM") & (h == 12), F.lit(0)).otherwise(h)
        return h * 60 + F.get(minutes, F.lit(i)).cast("int")

    start, end = at_index(0), at_index(1)
    inside = F.when(end <= start, (minute >= start) | (minute < end)).otherwise((minute >= start) & (minute < end))
    closed = F.lower(today) == "closed"
    is_open = F.coalesce(~closed & (F.size(hours) >= 2) & inside, F.lit(False))

    def upcoming(step: int) -> Column:
        name = _day_name(F.pmod(day + step, F.lit(7)))
        rest = _after_colon(_line_for(lines, name))
        opens = F.regexp_extract(rest, r"(?i)(\d{1,2}:\d{2}\s*(?:AM|PM))", 1)
        text = F.when(opens != "", F.concat(F.lit("Opens "), name, F.lit(" at "), opens)).otherwise(
            F.concat(F.lit("Opens "), name)
        )
        return F.when(rest.isNotNull() & (F.lower(rest) != "closed"), text)

    next_open = F.coalesce(*[upcoming(i) for i in range(1, 8)])
    return F.struct(
        is_open.alias("is_open"),
        F.when(closed, F.lit("Closed")).otherwise(today).alias("today_hours"),
        F.when(today.isNotNull() & ~is_open, next_open).alias("next_open"),
    )


def hours_status(periods: Column, lines: Column, at: Column) -> Column:
    """Periods decide when there are any, else the weekday texts, else closed with nothing to show."""
    empty = F.struct(
        F.lit(False).alias("is_open"), F.lit(None).cast("string").alias("today_hours"),
        F.lit(None).cast("string").alias("next_open"),
    )
    return (
        F.when(F.coalesce(F.size(periods) > 0, F.lit(False)), status_from_periods(periods, at))
        .when(F.coalesce(F.size(lines) > 0, F.lit(False)), status_from_lines(lines, at))
        .otherwise(empty)
    )


def open_run(lines: Column) -> Column:
    """"Open Mon-Sat", "Open Tue", "Open daily" for the first longest run of open days; null if none.

    The week is written as seven 0/1 flags, so a run of n open days is found with one string search per length.
    """
    week = cat.DAY_NAMES[1:] + cat.DAY_NAMES[:1]
    short = [d[:3] for d in week]

    def flag(day: str) -> Column:
        hits = F.filter(lines, lambda x: F.lower(x).startswith(day.lower()))
        last = let(hits, lambda h: F.get(h, F.size(h) - 1))
        return let(last, lambda x: F.when(x.isNotNull() & ~F.contains(F.lower(x), F.lit("closed")), "1").otherwise("0"))

    def named(flags: Column) -> Column:
        names = F.array(*[F.lit(s) for s in short])
        text = F.when(F.instr(flags, "1" * 7) > 0, F.lit("Open daily"))
        for n in range(6, 1, -1):
            at = F.instr(flags, "1" * n)
            text = text.when(
                at > 0, F.concat(F.lit("Open "), F.get(names, at - 1), F.lit("-"), F.get(names, at + n - 2))
            )
        at = F.instr(flags, "1")
        return text.when(at > 0, F.concat(F.lit("Open "), F.get(names, at - 1)))

    return F.when(lines.isNotNull(), let(F.concat(*[flag(d) for d in week]), named))
