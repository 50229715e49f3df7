"""Currency, dates and time zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zones of abbreviations and cities. An abbreviation stands for its zone's rule on that day.
ZONES = {
    "utc": "UTC",
    "gmt": "Etc/GMT",
    "est": "America/New_York",
    "edt": "America/New_York",
    "nyc": "America/New_York",
    "boston": "America/New_York",
    "miami": "America/New_York",
    "atlanta": "America/New_York",
    "new york": "America/New_York",
    "cst": "America/Chicago",
    "cdt": "America/Chicago",
    "chicago": "America/Chicago",
    "austin": "America/Chicago",
    "dallas": "America/Chicago",
    "houston": "America/Chicago",
    "mst": "America/Denver",
    "mdt": "America/Denver",
    "denver": "America/Denver",
    "pst": "America/Los_Angeles",
    "pdt": "America/Los_Angeles",
    "la": "America/Los_Angeles",
    "sf": "America/Los_Angeles",
    "seattle": "America/Los_Angeles",
    "los angeles": "America/Los_Angeles",
    "san francisco": "America/Los_Angeles",
    "bst": "Europe/London",
    "london": "Europe/London",
    "cet": "Europe/Paris",
    "cest": "Europe/Paris",
    "paris": "Europe/Paris",
    "eet": "Europe/Helsinki",
    "eest": "Europe/Helsinki",
    "helsinki": "Europe/Helsinki",
    "msk": "Europe/Moscow",
    "moscow": "Europe/Moscow",
    "ist": "Asia/Kolkata",
    "mumbai": "Asia/Kolkata",
    "delhi": "Asia/Kolkata",
    "bangalore": "Asia/Kolkata",
    "jst": "Asia/Tokyo",
    "tokyo": "Asia/Tokyo",
    "kst": "Asia/Seoul",
    "seoul": "Asia/Seoul",
    "hkt": "Asia/Hong_Kong",
    "hong kong": "Asia/Hong_Kong",
    "sgt": "Asia/Singapore",
    "singapore": "Asia/Singapore",
    "aest": "Australia/Sydney",
    "aedt": "Australia/Sydney",
    "sydney": "Australia/Sydney",
    "awst": "Australia/Perth",
    "perth": "Australia/Perth",
    "nzst": "Pacific/Auckland",
    "nzdt": "Pacific/Auckland",
    "auckland": "Pacific/Auckland",
    "brt": "America/Sao_Paulo",
    "sao paulo": "America/Sao_Paulo",
    "berlin": "Europe/Berlin",
    "budapest": "Europe/Budapest",
    "vienna": "Europe/Vienna",
    "prague": "Europe/Prague",
    "warsaw": "Europe/Warsaw",
    "madrid": "Europe/Madrid",
    "rome": "Europe/Rome",
    "amsterdam": "Europe/Amsterdam",
    "brussels": "Europe/Brussels",
    "zurich": "Europe/Zurich",
    "geneva": "Europe/Zurich",
    "stockholm": "Europe/Stockholm",
    "oslo": "Europe/Oslo",
    "copenhagen": "Europe/Copenhagen",
    "lisbon": "Europe/Lisbon",
    "dublin": "Europe/Dublin",
    "athens": "Europe/Athens",
    "istanbul": "Europe/Istanbul",
    "kyiv": "Europe/Kyiv",
    "kiev": "Europe/Kyiv",
    "cairo": "Africa/Cairo",
    "tel aviv": "Asia/Jerusalem",
    "dubai": "Asia/Dubai",
    "shanghai": "Asia/Shanghai",
    "beijing": "Asia/Shanghai",
    "melbourne": "Australia/Melbourne",
    "toronto": "America/Toronto",
    "mexico city": "America/Mexico_City",
    "vancouver": "America/Vancouver",
    "buenos aires": "America/Argentina/Buenos_Aires",
}
DAY_MS = 86_400_000


def zone_table(spark: SparkSession) -> DataFrame:
    """(alias, zone), some 80 rows."""
    return spark.createDataFrame(list(ZONES.items()), "alias string, zone string")


def convert_currency(amounts: DataFrame, rates: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """amounts(amount, from, to, ...) with converted = amount x rate(to) / rate(from), and provenance: the date of rates
    older than a day. An unknown code gives no result. rates(currency, rate, fetched_at): a row for each currency."""
    by = lambda col: rates.select(F.col("currency").alias(f"{col}_code"), F.col("rate").alias(f"{col}_rate"), F.col("fetched_at").alias(f"{col}_at"))
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    joined = amounts.join(by("from"), F.upper("from") == F.col("from_code"), "left").join(by("to"), F.upper("to") == F.col("to_code"), "left")
    old = F.least("from_at", "to_at")
    return (
        joined.withColumn("converted", F.col("amount") * F.col("to_rate") / F.col("from_rate"))
        .withColumn("provenance", F.when((now - old > DAY_MS) & F.col("converted").isNotNull(), F.date_format(F.timestamp_millis(old), "yyyy-MM-dd")))
        .drop("from_code", "from_rate", "from_at", "to_code", "to_rate", "to_at")
    )


def shift_dates(df: DataFrame, at_col: str = "at", n_col: str = "n", unit_col: str = "unit") -> DataFrame:
    """df with shifted, n units after at, and label: month ends clamp; the label has a clock for minutes and hours only."""
    at, n = F.col(at_col), F.col(n_col)
    given = F.regexp_replace(F.lower(unit_col), "s+$", "")
    unit = F.when(given == "min", "minute").when(given.isin("hr", "h"), "hour").otherwise(given)
    seconds = F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86_400).when(unit == "week", 604_800)
    months = F.when(unit == "month", 1).when(unit == "year", 12)
    by_months = F.make_interval(months=(n * months).cast("int"))
    shifted = F.when(seconds.isNotNull(), F.timestamp_seconds(F.unix_timestamp(at) + n * seconds)).when(months.isNotNull(), at + by_months)
    with_clock = unit.isin("minute", "hour")
    return df.withColumn("shifted", shifted).withColumn("label", F.when(with_clock, F.date_format("shifted", "EEE, MMM d yyyy HH:mm")).otherwise(F.date_format("shifted", "EEE, MMM d yyyy")))


def days_until(df: DataFrame, today_col: str = "today", month_col: str = "month", day_col: str = "day") -> DataFrame:
    """df with target, the next such day on or after today, and days until then; null where there is no such day."""
    in_year = lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, F.col(month_col), F.col(day_col)), "yyyy-MM-dd")
    this, following = in_year(F.year(today_col)), in_year(F.year(today_col) + 1)
    target = F.when(this >= F.col(today_col), this).otherwise(following)
    return df.withColumn("target", target).withColumn("days", F.datediff(F.col("target"), F.col(today_col)))


def resolve_zone(names: DataFrame, col: str, zones: DataFrame, into: str) -> DataFrame:
    """names with the zone of a name: an alias, a fixed offset such as utc+0530, or a zone's own name."""
    name = F.lower(F.trim(col))
    sign, hours, minutes = (F.regexp_extract(name, r"^(?:utc|gmt)([+-])(\d{1,2}):?(\d{2})?$", k) for k in (1, 2, 3))
    whole = F.coalesce(hours.try_cast("int"), F.lit(99))
    offset = F.when((sign != "") & (whole <= 14), F.concat(sign, F.lpad(hours, 2, "0"), F.lit(":"), F.when(minutes == "", "00").otherwise(minutes)))
    own = F.when(F.col(col).rlike("^[A-Z][A-Za-z_]+/[A-Za-z_/]+$"), F.col(col))
    alias = zones.select(F.col("alias").alias("alias_"), F.col("zone").alias("zone_"))
    return names.join(F.broadcast(alias), name == F.col("alias_"), "left").withColumn(into, F.coalesce("zone_", offset, own)).drop("alias_", "zone_")


def offset_label(offset: Column) -> Column:
    """UTC+5:30 of +05:30, UTC-5 of -05:00."""
    minutes = F.substring(offset, 5, 2)
    return F.concat(F.lit("UTC"), F.substring(offset, 1, 1), F.substring(offset, 2, 2).cast("int").cast("string"), F.when(minutes == "00", "").otherwise(F.concat(F.lit(":"), minutes)))


def convert_zones(df: DataFrame, zones: DataFrame, wall_col: str = "wall", from_col: str = "src", to_col: str = "dst") -> DataFrame:
    """df with converted: the wall time (TIMESTAMP_NTZ) in the other zone; null for unknown zones, and for a time that a
    change of clocks leaves out, which a round trip shows."""
    resolved = resolve_zone(resolve_zone(df, from_col, zones, "from_zone"), to_col, zones, "to_zone")
    there = lambda a, b, c: F.convert_timezone(a, b, c)
    utc = there(F.col("from_zone"), F.lit("UTC"), F.col(wall_col))
    exists = there(F.lit("UTC"), F.col("from_zone"), utc) == F.col(wall_col)
    known = F.col("from_zone").isNotNull() & F.col("to_zone").isNotNull()
    return resolved.withColumn("converted", F.when(known & exists, there(F.col("from_zone"), F.col("to_zone"), F.col(wall_col)))).drop("from_zone", "to_zone")


# Months of a year.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def date_phrases(df: DataFrame, zones: DataFrame, phrase_col: str = "phrase", now_col: str = "now") -> DataFrame:
    """df with kind and title of what a phrase asks at the time now (TIMESTAMP), both null for any other phrase.

    shift: now, today or tomorrow, or "now + 3 weeks" with up to five digits: the day, with a clock for hours and minutes.
    until: "days until" a day as 2026-12-25, 12/25, dec 25 or 25 dec: days to it, or to the next such day if it has no
    year. zone: "time in tokyo", "3pm est in cet", "utc to utc+2": the clock there. A time without a zone is the
    session's, a zone without a time means now, and a time is on the day that its own zone has. Names of months have
    three letters or more; a number alone is no time."""
    df = df.select(F.struct("*").alias("row_"), F.trim(F.regexp_replace(phrase_col, r"\s+", " ")).alias("said_"), F.col(now_col).alias("now_"))
    said, now, local = F.col("said_"), F.col("now_"), F.current_timezone()
    q = F.lower(said)
    part = lambda pattern, k, text=q: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    number = lambda c: c.try_cast("int")

    moved = r"^(now|today|tomorrow)(?: ?([+-]) ?(\d{1,5}) ([a-z]+))?$"
    base, count = part(moved, 1), number(part(moved, 3))
    rows = df.withColumns({
        "at_": F.when(base == "tomorrow", now + F.make_interval(days=F.lit(1))).when(base.isNotNull(), now),
        "n_": F.when(part(moved, 2) == "-", -count).otherwise(count).cast("long"), "unit_": part(moved, 4),
    })
    shifted = shift_dates(rows, "at_", "n_", "unit_").withColumn("moved_", F.when(F.col("unit_").isNull(), F.date_format("at_", "EEE, MMM d yyyy HH:mm")).when(F.col("shifted").isNotNull(), F.col("label")))

    day = part("^days until (.+)$", 1)
    slash, first, second = r"^(\d{1,2}) ?/ ?(\d{1,2})$", r"^([a-z]{3,9}) (\d{1,2})$", r"^(\d{1,2}) ([a-z]{3,9})$"
    name = F.coalesce(part(first, 1, day), part(second, 2, day))
    of_name = F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: F.startswith(m, name)), F.lit(True)).cast("int")
    iso = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(day, "yyyy-M-d"))
    due = days_until(shifted.drop("shifted", "label").withColumns({
        "today_": now.cast("date"), "month_": F.coalesce(number(part(slash, 1, day)), F.nullif(of_name, F.lit(0))),
        "day_": number(F.coalesce(part(slash, 2, day), part(first, 2, day), part(second, 1, day))),
    }), "today_", "month_", "day_")
    n = F.coalesce(F.datediff(iso, "today_"), F.col("days"))
    until = F.when(n == 0, "today").when(n == 1, "1 day").when(n < 0, F.concat((-n).cast("string"), F.lit(" days ago"))).otherwise(F.concat(n.cast("string"), F.lit(" days")))
    counted = due.withColumn("until_", F.when(n.isNotNull(), until))

    clock = r"(?i)^(?:(\d{1,2})(?::(\d{1,2}))? ?(am|pm)?(?: |$))?(?:(.*?) )??(?:in|to) (.+)$"
    hour, minute, half = number(part(clock, 1, said)), number(part(clock, 2, said)), F.lower(part(clock, 3, said))
    of_day = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    timed, sound = hour.isNotNull(), (minute.isNotNull() | half.isNotNull()) & (of_day < 24) & (F.coalesce(minute, F.lit(0)) < 60)
    place = part(clock, 4, said)
    here = place.isNull() | (~timed & F.lower(place).isin("time", "now"))
    asked = counted.withColumns({"src_": F.when(here, local).otherwise(place), "dst_": part(clock, 5, said)})
    there = F.convert_timezone(local, F.coalesce("from_", local), now.cast("timestamp_ntz"))
    midnight = F.date_trunc("day", there).cast("timestamp_ntz")
    wall = F.when(~timed, there).when(sound, midnight + F.make_dt_interval(hours=of_day, mins=F.coalesce(minute, F.lit(0))))
    walls = resolve_zone(asked, "src_", zones, "from_").withColumn("from_", F.when(here, local).otherwise(F.col("from_"))).withColumn("wall_", F.when(F.col("from_").isNotNull(), wall))
    named = walls.withColumn("src_", F.when(here, F.lit("utc+0")).otherwise(F.col("src_")))
    utc = F.when(here, F.convert_timezone(local, F.lit("UTC"), F.col("wall_"))).otherwise(F.col("wall_"))
    clocks = convert_zones(named.withColumn("wall_", utc), zones, "wall_", "src_", "dst_").withColumn("zone_", F.date_format("converted", "HH:mm"))
    kind = F.when(F.col("moved_").isNotNull(), "shift").when(F.col("until_").isNotNull(), "until").when(F.col("zone_").isNotNull(), "zone")
    return clocks.select("row_.*", kind.alias("kind"), F.coalesce("moved_", "until_", "zone_").alias("title"))
