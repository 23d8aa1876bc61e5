"""Weather codes, air quality, wind and places over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup

# Weather codes by condition, upper bounds of air-quality levels, directions from north on.
CONDITIONS = {"clear": [0], "cloudy": [1, 2, 3], "fog": [45, 48], "rain": [51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 80, 81, 82], "snow": [71, 73, 75, 77, 85, 86], "storm": [95, 96, 99]}
AIR_LEVELS = [(50, "good"), (100, "moderate"), (150, "unhealthy-sensitive"), (200, "unhealthy"), (300, "very-unhealthy")]
WORST_AIR = "hazardous"
CONDITION_LABELS = {"clear": "맑음", "cloudy": "구름 많음", "fog": "안개", "rain": "비", "snow": "눈", "storm": "뇌우", "unknown": "날씨 변화"}
AIR_LABELS = {"good": "좋음", "moderate": "보통", "unhealthy-sensitive": "민감군 주의", "unhealthy": "나쁨", "very-unhealthy": "매우 나쁨", "hazardous": "위험"}
DIRECTIONS = ["북", "북동", "동", "남동", "남", "남서", "서", "북서"]
CURRENT = "struct<time:string,temperature_2m:double,apparent_temperature:double,relative_humidity_2m:double,precipitation:double,cloud_cover:double,weather_code:double,wind_speed_10m:double,wind_direction_10m:double>"
RANGES = {"temperature_2m": (-100, 70), "apparent_temperature": (-120, 80), "relative_humidity_2m": (0, 100), "precipitation": (0, None), "cloud_cover": (0, 100), "weather_code": (0, 99), "wind_speed_10m": (0, None), "wind_direction_10m": (0, 360)}
AIR = "struct<us_aqi:double,pm2_5:double,pm10:double>"
PLACE = "struct<city:string,town:string,municipality:string,county:string,state:string,borough:string,city_district:string>"
FALLBACK = (37.57, 126.98, "서울")


def condition(code: Column) -> Column:
    out = F.lit("unknown")
    for name, codes in reversed(CONDITIONS.items()):
        out = F.when(code.isin(codes), name).otherwise(out)
    return out


def air_level(index: Column) -> Column:
    out = F.lit(WORST_AIR)
    for bound, name in reversed(AIR_LEVELS):
        out = F.when(index <= bound, name).otherwise(out)
    return out


def condition_label(condition_: Column) -> Column:
    return lookup(condition_, CONDITION_LABELS)


def air_label(level: Column) -> Column:
    return lookup(level, AIR_LABELS)


def half_up(c: Column) -> Column:
    """Rounded to a whole number, halves upwards (Spark's round takes them away from zero)."""
    return F.floor(c + 0.5)


def rounded(c: Column, places: int = 2) -> Column:
    return half_up(c * 10**places) / 10**places


def wind_label(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.pmod(half_up(degrees / 45), F.lit(8)) + 1).cast("int"))


def location(latitude: Column, longitude: Column) -> Column:
    """struct(latitude, longitude, label): rounded coordinates, or the fixed place if one is missing."""
    known = latitude.isNotNull() & longitude.isNotNull()
    pick = lambda value, other: F.when(known, value).otherwise(F.lit(other))
    return F.struct(pick(rounded(latitude), FALLBACK[0]).alias("latitude"), pick(rounded(longitude), FALLBACK[1]).alias("longitude"), pick(F.lit("현재 위치"), FALLBACK[2]).alias("label"))


def _in_ranges(c: Column, ranges: dict) -> Column:
    ok = F.lit(True)
    for name, (low, high) in ranges.items():
        ok &= c[name].isNotNull() & (c[name] >= low) & (F.lit(True) if high is None else c[name] <= high)
    return F.coalesce(ok, F.lit(False))


def current_weather(json: Column) -> Column:
    """The observation in a response, or null if a field is missing or out of range."""
    c = F.from_json(json, f"struct<current:{CURRENT}>")["current"]
    ok = c["time"].rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}\z") & _in_ranges(c, RANGES) & (c["weather_code"] == F.floor(c["weather_code"]))
    return F.when(ok, c)


def air_quality(json: Column) -> Column:
    c = F.from_json(json, f"struct<current:{AIR}>")["current"]
    ok = _in_ranges(c, {"us_aqi": (0, 500), "pm2_5": (0, None), "pm10": (0, None)}) & (c["us_aqi"] == F.floor(c["us_aqi"]))
    return F.when(ok, F.struct(c["us_aqi"].alias("us_aqi"), air_level(c["us_aqi"]).alias("level"), c["pm2_5"].alias("pm25"), c["pm10"].alias("pm10")))


def place(json: Column) -> Column:
    """struct(city, district) of a reverse look-up; a district named as its city is none."""
    a = F.from_json(json, f"struct<address:{PLACE}>")["address"]
    city = F.coalesce(a["city"], a["town"], a["municipality"], a["county"], a["state"])
    return F.when(city.isNotNull(), F.struct(city.alias("city"), F.nullif(F.coalesce(a["borough"], a["city_district"]), city).alias("district")))
