"""Cron expressions, change frequencies and sitemap priorities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Change frequency, its bonus and its schedule (none for never).
FREQUENCIES = [
    ("always", 5, "*/5 * * * *"), ("hourly", 4, "0 * * * *"), ("daily", 3, "0 0 * * *"), ("weekly", 2, "0 0 * * 0"), ("monthly", 1, "0 0 1 * *"),
    ("yearly", 0, "0 0 1 1 *"), ("never", -1, None),
]


def _read(pattern: Column) -> dict[str, Column]:
    """What one field says: its form and its numbers."""
    of = lambda form, i: F.regexp_extract(pattern, form, i).try_cast("int")
    return {
        "all": pattern == "*", "steps": pattern.startswith("*/"), "step": of(r"^\*/(\d+)$", 1), "list": pattern.contains(","), "some": F.transform(F.split(pattern, ","), lambda x: F.trim(x).try_cast("int")),
        "range": pattern.contains("-"), "low": of(r"^(\d+)-(\d+)$", 1), "high": of(r"^(\d+)-(\d+)$", 2), "one": pattern.try_cast("int")}


def _fits(x: dict[str, Column] | Column, value: Column) -> Column:
    """Whether a value fits a field as read."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(x["all"], True).when(x["steps"], yes((x["step"] > 0) & (value % F.when(x["step"] > 0, x["step"]).otherwise(1) == 0)))
        .when(x["list"], yes(F.array_contains(x["some"], value))).when(x["range"], yes(value.between(x["low"], x["high"]))).otherwise(yes(value == x["one"]))
    )


def field(pattern: Column, value: Column) -> Column:
    """One field: *, */n (a multiple of n), a list, a range or a number; anything else doesn't match."""
    return _fits(_read(pattern), value)


def _bits(pattern: Column, low: int, high: int) -> Column:
    """The values from `low` to `high` that fit a field, as the bits of a long; the field is read once."""
    read = F.array(F.struct(*[c.alias(k) for k, c in _read(pattern).items()]))
    bit = lambda x, v: F.when(_fits(x, v), F.expr("1L")).otherwise(F.expr("0L"))
    sums = F.transform(read, lambda x: F.aggregate(F.sequence(F.lit(low), F.lit(high)), F.expr("0L"), lambda s, v: s.bitwiseOR(F.call_function("shiftleft", bit(x, v), v))))
    return F.get(sums, F.lit(0))


def _from(bits: Column, low: Column) -> Column:
    """The bits from `low` on."""
    return bits.bitwiseAND(F.call_function("shiftleft", F.expr("-1L"), low))


def _lowest(bits: Column) -> Column:
    """The place of the lowest bit; null if there is none."""
    return F.when(bits != 0, F.bit_count(bits.bitwiseAND(-bits) - 1))


def matches(cron: Column, at: Column, sunday0: bool = False) -> Column:
    """Whether a time matches all five fields; days of the week count from Monday unless `sunday0`."""
    part = lambda i: F.split(F.trim(cron), r"\s+")[i]
    day = F.weekday(at)
    return (
        (F.size(F.split(F.trim(cron), r"\s+")) == 5) & field(part(0), F.minute(at)) & field(part(1), F.hour(at)) & field(part(2), F.dayofmonth(at))
        & field(part(3), F.month(at)) & field(part(4), (day + 1) % 7 if sunday0 else day)
    )


def next_run(schedules: DataFrame, days: int = 366) -> DataFrame:
    """`schedules` (target, cron, after) with the first matching minute after `after`, within `days`; else a day later.

    A field is read once, to the bits of what fits it, and days are looked for by month, so that nothing like a year of days
    or minutes is made. Rows are dealt to all tasks, since they may come from a small aggregate.
    """
    part = lambda i: F.get(F.split(F.trim(F.col("cron")), r"\s+"), F.lit(i))
    start = F.date_trunc("minute", F.col("after")) + F.expr("interval 1 minute")
    spread = schedules.repartition(schedules.sparkSession.sparkContext.defaultParallelism)
    sets = F.struct(start.alias("start"), *[_bits(part(i), low, high).alias(n) for i, (n, low, high) in enumerate((("minutes", 0, 59), ("hours", 0, 23), ("days", 1, 31), ("months", 1, 12), ("weekdays", 0, 6)))])

    def run(x: Column) -> Column:
        day, hour, minute = F.to_date(x["start"]), F.hour(x["start"]), F.minute(x["start"])
        has = lambda bits, v: F.call_function("shiftright", bits, v).bitwiseAND(F.lit(1)) == 1
        at = lambda hours, minutes: _lowest(hours) * 60 + _lowest(minutes)
        now = F.when(has(x["hours"], hour), hour * 60 + _lowest(_from(x["minutes"], minute)))
        today = F.when(
            has(x["days"], F.dayofmonth(day)) & has(x["months"], F.month(day)) & has(x["weekdays"], F.weekday(day)), F.coalesce(now, at(_from(x["hours"], hour + 1), x["minutes"])))
        weeks = x["weekdays"] * F.lit(sum(1 << 7 * i for i in range(6)))

        def of_month(k: Column) -> Column:
            first = F.add_months(F.trunc(day, "month"), k)
            fit = F.call_function("shiftleft", F.call_function("shiftright", weeks, F.weekday(first)), F.lit(1)).bitwiseAND(x["days"])
            fit = _from(fit, F.when(k == 0, F.dayofmonth(day) + 1).otherwise(1))
            fit = fit.bitwiseAND(F.call_function("shiftleft", F.expr("1L"), F.dayofmonth(F.last_day(first)) + 1) - 1)
            return F.when(has(x["months"], F.month(first)), F.date_add(first, _lowest(fit) - 1))

        other = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(days // 28 + 1)), of_month))
        other = F.when(other <= F.date_add(day, days), other)
        return F.coalesce(F.timestamp_add("MINUTE", today, day.cast("timestamp")), F.timestamp_add("MINUTE", at(x["hours"], x["minutes"]), other.cast("timestamp")))

    found = F.get(F.transform(F.array(sets), run), F.lit(0))
    return spread.withColumn("next_run", F.coalesce(found, F.col("after") + F.expr("interval 1 day")))


def frequency(value: Column, what: int) -> Column:
    """Bonus (1) or schedule (2) of a change frequency; null for others."""
    out = F.lit(None)
    for row in FREQUENCIES:
        out = F.when(F.lower(value) == row[0], F.lit(row[what])).otherwise(out)
    return out


def sitemap_score(priority: Column, freq: Column, age_days: Column) -> Column:
    """Ten times the priority (5 where it is missing or 0), plus the frequency's bonus, plus 5, 3 or 1 for recent changes."""
    recent = F.when(age_days < 1, 5).when(age_days < 7, 3).when(age_days < 30, 1).otherwise(0)
    return F.when(priority.isNull() | (priority == 0), 5.0).otherwise(priority * 10) + F.coalesce(frequency(freq, 1), F.lit(0)) + recent


def lastmod(text: Column) -> Column:
    """A sitemap's date in one of its usual forms, else null."""
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd", "yyyy-MM", "yyyy"]
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms])
