"""Serialised Python dictionaries (as in place attributes and hours) to maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens.functions.columns import any_of

MAP = "map<string,string>"
# A bare True/False/None that sits outside double quotes.
_BARE = r"(?<=:\s)(True|False|None)(?=\s*[,}])(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), MAP)


def parse_dict(c: Column) -> Column:
    """Dictionary text to map; anything that cannot be read becomes an empty map."""
    text = F.trim(F.coalesce(c, F.lit("")))
    plain = F.regexp_replace(text, r"\bu(['\"])", "$1")
    quoted = F.regexp_replace(plain, _BARE, "\"$1\"")
    parsed = F.from_json(quoted, MAP, {"allowSingleQuotes": "true"})
    return F.when(text.startswith("{"), F.coalesce(parsed, empty_map())).otherwise(empty_map())


def is_nested(v: Column) -> Column:
    t = F.trim(v)
    return t.startswith("{") & t.endswith("}")


def clean_value(v: Column) -> Column:
    """One attribute value in the string domain: true/false to 1/0, digits kept, quotes and u-prefix dropped."""
    t = F.regexp_replace(F.regexp_replace(F.trim(v), "u'", ""), "'", "")
    low = F.lower(t)
    return (
        F.when(low == "true", F.lit("1"))
        .when(low == "false", F.lit("0"))
        .when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", ""))
        .otherwise(t)
    )


def snake_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tri_state(v: Column) -> Column:
    """1 for a yes, 0 for a no, NULL for anything else."""
    t = F.lower(F.trim(v))
    return F.when(t.isin("true", "1", "yes"), 1.0).when(t.isin("false", "0", "no"), 0.0)


def hour_spans(hours: Column) -> Column:
    """Array of (day, open hour, close hour) for the days whose span can be read."""

    def span(e):
        sides = F.split(e["value"], "-")
        hour = lambda i: F.split(F.get(sides, F.lit(i)), ":")[0].try_cast("int")
        return F.struct(
            e["key"].alias("day"),
            hour(0).alias("open"),
            F.when(F.size(sides) >= 2, hour(1)).alias("close"),
        )

    rows = F.transform(F.map_entries(parse_dict(hours)), span)
    return F.filter(rows, lambda s: s["open"].isNotNull() & s["close"].isNotNull())


def hours_flags(hours: Column) -> dict[str, Column]:
    spans = hour_spans(hours)
    late = lambda s: (s["close"] >= 22) | (s["close"] < s["open"])
    return {
        "time_is_open_morning": F.exists(spans, lambda s: s["open"] < 10).cast("int"),
        "time_is_open_latenight": F.exists(spans, late).cast("int"),
        "time_open_on_weekends": F.exists(spans, lambda s: s["day"].isin("Saturday", "Sunday")).cast("int"),
    }


def days_open(hours: Column) -> Column:
    """Days with a real span; NULL when no dictionary could be read."""
    parsed = parse_dict(hours)

    def real(v):
        t = F.lower(F.trim(v))
        return ~any_of([t == "", t == "none", t == "closed", t.startswith("0:0-0:0")])

    values = F.filter(F.map_values(parsed), lambda v: F.coalesce(real(v), F.lit(False)))
    return F.when(F.size(parsed) > 0, F.size(values).cast("double"))
