"""Labels of weather codes, routes and headsigns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weather condition codes.
CONDITIONS = {
    1000: "Clear", 1003: "Partly cloudy", 1006: "Cloudy", 1009: "Overcast", 1030: "Mist",
    1063: "Patchy rain", 1066: "Patchy snow", 1069: "Patchy sleet", 1072: "Patchy freezing drizzle", 1087: "Thundery outbreaks",
    1114: "Blowing snow", 1117: "Blizzard", 1135: "Fog", 1147: "Freezing fog", 1150: "Light drizzle", 1153: "Light drizzle",
    1168: "Freezing drizzle", 1171: "Heavy freezing drizzle", 1180: "Light rain", 1183: "Light rain", 1186: "Moderate rain",
    1189: "Moderate rain", 1192: "Heavy rain", 1195: "Heavy rain", 1198: "Light freezing rain", 1201: "Freezing rain",
    1204: "Light sleet", 1207: "Sleet", 1210: "Light snow", 1213: "Light snow", 1216: "Moderate snow", 1219: "Moderate snow",
    1222: "Heavy snow", 1225: "Heavy snow", 1237: "Ice pellets", 1240: "Light showers", 1243: "Showers", 1246: "Torrential rain",
    1249: "Light sleet showers", 1252: "Sleet showers", 1255: "Light snow showers", 1258: "Snow showers", 1261: "Ice pellet showers",
    1264: "Ice pellet showers", 1273: "Thunderstorm", 1276: "Thunderstorm", 1279: "Snow thunderstorm", 1282: "Snow thunderstorm",
}
#: The codes that are wet without measured rain.
WET_CODES = [1063, 1069, 1072, 1087, 1150, 1153, 1168, 1171, 1180, 1183, 1186, 1189, 1192, 1195, 1198, 1201, 1204, 1207, 1240, 1243, 1246, 1249, 1252, 1273, 1276]
#: Words of a headsign that stay in capitals.
ACRONYMS = ("Mrt", "Lrt", "Ktm", "Brt", "Kl", "Utc", "Ppr")


def weather_label(code: Column) -> Column:
    named = F.create_map(*[F.lit(x) for x in chain.from_iterable(CONDITIONS.items())])
    return F.when(code.isNull(), "Unknown").otherwise(F.coalesce(F.try_element_at(named, code.cast("int")), F.concat(F.lit("Code "), code.cast("string"))))


def is_rainy(precip: Column, code: Column) -> Column:
    return F.coalesce(precip > 0, F.lit(False)) | F.coalesce(code.isin(WET_CODES), F.lit(False))


def title_case_headsign(text: Column) -> Column:
    """Lower case with a capital at each ASCII word boundary, acronyms in capitals, and " ~ " for " - "."""
    marked = F.regexp_replace(F.lower(text), r"\b([a-z])", "\u0001$1")
    parts = F.split(marked, "\u0001")
    raised = F.array_join(F.transform(parts, lambda x, k: F.when(k == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))), "")
    for word in ACRONYMS:
        raised = F.regexp_replace(raised, rf"\b{word}\b", word.upper())
    return F.regexp_replace(raised, " - ", " ~ ")


def route_label(route_id: Column, short: Column, long: Column, headsign: Column) -> Column:
    """"short – long"; a bare code with its commonest headsign; else the code, or the id."""
    short, long = F.trim(F.coalesce(short, F.lit(""))), F.trim(F.coalesce(long, F.lit("")))
    code = F.when(short != "", short).otherwise(long)
    return (
        F.when((short != "") & (long != ""), F.concat(short, F.lit(" – "), long))
        .when(code.rlike(r"^[A-Z]{0,3}\d+[A-Za-z]*$") & (F.coalesce(headsign, F.lit("")) != ""), F.concat(code, F.lit(" – "), title_case_headsign(headsign)))
        .when(code != "", code)
        .otherwise(route_id)
    )


def is_unknown_route(route: Column, learning: bool = False) -> Column:
    """Null, empty or Unknown; while learning also the text null."""
    return route.isNull() | route.isin("", "Unknown", *["null"] * learning)
