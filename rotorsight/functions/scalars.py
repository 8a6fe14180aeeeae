"""Small column expressions: null-safe comparisons, rounding, alarms, ids, hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import limits as L


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_array(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# White space as a text library strips it (not only the blank).
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"


def strip(value) -> Column:
    """Both ends without white space of any kind."""
    return F.btrim(col(value), F.lit(WHITE))


# ---- numbers -----------------------------------------------------------------------------------

def at_least(value, threshold) -> Column:
    """``value >= threshold``; a missing value is not satisfied."""
    return F.coalesce(col(value) >= threshold, F.lit(False))


def above(value, threshold) -> Column:
    return F.coalesce(col(value) > threshold, F.lit(False))


def below(value, threshold) -> Column:
    return F.coalesce(col(value) < threshold, F.lit(False))


def stable_round(value, digits: int) -> Column:
    """Round after dropping noise beyond nine digits.

    Distributed sums add in no fixed order, so the last bits of a mean differ from run to run.
    Rounding at nine digits first keeps ties (and thus hashes of results) the same on every run.
    """
    return F.round(F.round(col(value), 9), digits)


def plain_number(value, digits: int | None = None) -> Column:
    """NaN becomes null; optionally rounded."""
    clean = F.when(~F.isnan(col(value)), col(value))
    return clean if digits is None else stable_round(clean, digits)


def deviation_pct(value, rated: float) -> Column:
    """Deviation from the rated figure in percent."""
    return (col(value) - rated) / rated * 100


# ---- alarms and times --------------------------------------------------------------------------

def is_alarm(code) -> Column:
    """True for a real alarm string: not blank and not one of the 'no alarm' spellings."""
    return F.coalesce(~F.trim(col(code)).isin(L.NO_ALARM), F.lit(False))


def alarm_codes(code) -> Column:
    """``;``-joined alarm string to an array of codes, sentinels removed."""
    parts = F.transform(F.split(col(code), ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: ~x.isin(L.NO_ALARM))


def alarm_from_readings(is_trip: Column | None = None) -> Column:
    """The eight alarm codes derived from the readings of one frame, sorted and joined."""
    hottest = F.greatest("temp_de", "temp_nde")
    shaking = F.greatest("vib_rms_de", "vib_rms_nde")
    current = F.col("motor_current")
    # Listed in alphabetical order, so joining the non-null ones gives the sorted string.
    joined = F.concat_ws(
        ";", F.when(F.col("flow_rate") < L.FLOW_WARN_LOW, "FAL-104"),
        F.when(current >= L.CURRENT_HIGH, "IAH-106")
         .when(current < L.CURRENT_LOW_ALARM, "IAL-105"),
        F.when(F.col("press_in") < L.PRESS_IN_WARN, "PAL-103"),
        F.when(hottest >= L.TEMP_TRIP, "TAHH-101").when(hottest >= L.TEMP_WARN, "TAH-101"),
        F.when(shaking > L.VIB_TRIP, "VAHH-102").when(shaking > L.VIB_WARN, "VAH-102"))
    codes = F.coalesce(F.nullif(joined, F.lit("")), F.lit("NONE"))
    return codes if is_trip is None else F.when(is_trip, "NONE").otherwise(codes)


def parse_time(text) -> Column:
    """ISO text, with or without a trailing Z, to a UTC timestamp."""
    return F.to_timestamp(F.regexp_replace(col(text), "Z", ""))


def iso(ts) -> Column:
    """Timestamp to ISO text, seconds resolution."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


# ---- ids, references, hashes --------------------------------------------------------------------

def evidence_ref(kind, ident, locator) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(kind).alias("kind"), lit(ident).alias("id"), lit(locator).alias("locator"))


def canonical_sha256(*fields: Column) -> Column:
    """SHA-256 over the JSON text of the fields; callers pass them in one fixed order."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def tail_name(path) -> Column:
    """Last part of a path or URL; the whole text when there is none."""
    clean = F.regexp_replace(F.regexp_replace(col(path), r"\\", "/"), "/+$", "")
    last = F.element_at(F.split(clean, "/"), -1)
    return F.when(F.length(last) > 0, last).otherwise(col(path))


def confidence_band(score) -> Column:
    s = col(score)
    return (F.when(s >= 0.8, "HIGH").when(s >= 0.5, "MEDIUM").when(s > 0, "LOW")
            .otherwise("UNKNOWN"))


def image_type(content) -> Column:
    """MIME type from the leading bytes; null when the format is not supported."""
    head = F.hex(F.substring(col(content), 1, 12))
    return (F.when(head.startswith("FFD8FF"), "image/jpeg")
            .when(head.startswith("89504E470D0A1A0A"), "image/png")
            .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
            .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"),
                  "image/webp"))


def data_url(content, mime) -> Column:
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"),
                    F.regexp_replace(F.base64(col(content)), r"[\r\n]", ""))


def query_key(text) -> Column:
    """Comparison key of a query: no white space, no closing punctuation."""
    tail = "[" + L.QUERY_TAIL_PUNCTUATION.replace("?", "\\?").replace(".", "\\.") + "]+$"
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\s\p{Z}]+", ""),
                            tail, "")
