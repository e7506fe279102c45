"""Problem 4: mixed timestamp formats and time zones.

Method: expectation-maximisation over format mixtures per source.  Every written
value is parsed in each reading it admits (a date with slashes or dots has two,
month first and day first; any other notation has one).  A source is a mixture of readings; a
value contributes to every reading by its posterior, that is, by the weight of the reading times
the likelihood of the value under it: 1 if that is within a day of when the value was
received, less if farther off; the mixture follows from the posteriors, and so on until they rest.
A value gets the reading whose posterior reaches ``confidence``; else it is
marked as unresolved.  A reading under which a value is no real date counts only where the
convention of its notation is declared.  A declared convention is a strong prior of the
mixture (``DECLARED`` values a value seen), so that the posterior then all but follows it: a value
that is no date under the declared convention is taken for a mistake and not for one of the other convention.

Sources are summed by the set of readings and likelihoods their values admit before anything is
fitted, so a source is a handful of rows however many values it has.

An offset, zone or abbreviation in the value holds (an abbreviation is one of
the row's zone); else the row's zone does.  Every value gets one state:
``instant``, ``unresolved`` (several readings, none sure), ``twice`` or ``never``
(local times in a zone's overlap or gap), ``no_zone``, ``impossible`` (no such
date or time) or ``filler`` (no notation of a time; also empty values).  Nulls
give no row.  Instants are unix milliseconds, rounded down.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Container, Iterator
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnestra.session import materialise, spread

_ZONE = r"(?:\s*(?P<off>[Zz]|[+-]\d{2}(?::?\d{2})?)(?![\d:]))?(?:\s*\[(?P<in>[^\]]+)\]|\s*(?P<name>[A-Za-z]{2,5}(?![A-Za-z/_])|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+))?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?" + _ZONE
_REST = rf"(?:(?:,?\s+|[Tt])(?:at\s+)?{_TIME})?$"
_NUMBERS = {10: 1000, 13: 1, 16: 1000, 19: 1_000_000}
#: The names of the months, by their first three letters.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FULL = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH_OF = {**{m: i + 1 for i, m in enumerate(_MONTHS)}, **{m: i + 1 for i, m in enumerate(_FULL)}, "sept": 9}
_YEAR_FIRST = re.compile(rf"(?P<y>\d{{4}})([-/])(?P<m>\d{{1,2}})\2(?P<d>\d{{1,2}}){_REST}")
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?(?P<ap>(?!))?{_ZONE}$")
_YEAR_LAST = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}){_REST}")
_DAY_MONTH = re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})\s+(?P<mon>[A-Za-z]{{3,9}})\.?,?\s+(?P<y>\d{{4}}){_REST}")
_MONTH_DAY = re.compile(rf"(?:[A-Za-z]{{3,9}},\s+)?(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_REST}")
_KOREAN = re.compile(r"(?P<y>\d{4})년\s*(?P<m>\d{1,2})월\s*(?P<d>\d{1,2})일(?:\s*(?P<ap>오전|오후)?\s*(?P<h>\d{1,2})시(?:\s*(?P<mi>\d{1,2})분)?(?:\s*(?P<s>\d{1,2})초)?(?P<f>(?!))?" + _ZONE + r")?$")
_EPOCH = dt.datetime(1970, 1, 1)
_UTC_NAMES = {"z", "utc", "gmt", "ut"}
DECLARED = 1e6
LIKELIHOOD = (0.01, 0.2, 0.6, 1.0)  # of a value that is no date, or lies far off, within a month, within a day
_MONTH_MS, _DAY_MS = 31 * 86_400_000, 86_400_000

Reading = tuple[str, str, int | None]  # reading, state, milliseconds


def fit_of(state: str, ms: int | None, seen_ms: int | None) -> int:
    """Which ``LIKELIHOOD`` a reading has; without an instant or a time of receipt it is as likely as can be."""
    if state == "impossible":
        return 0
    if ms is None or seen_ms is None:
        return 3
    off = abs(ms - seen_ms)
    return 3 if off <= _DAY_MS else 2 if off <= _MONTH_MS else 1


class Zones:
    """Zones by name, and the offsets that their abbreviations stand for."""

    def __init__(self) -> None:
        self._zones: dict[str, ZoneInfo | None] = {}
        self._short: dict[tuple[str, int], dict[str, set[int]]] = {}

    def get(self, name: str) -> ZoneInfo | None:
        if name not in self._zones:
            try:
                self._zones[name] = ZoneInfo("UTC" if name.lower() in _UTC_NAMES else name)
            except Exception:
                self._zones[name] = None
        return self._zones[name]

    def short(self, name: str, year: int) -> dict[str, set[int]]:
        """Offsets in seconds by abbreviation, of the days of a year and its neighbours."""
        if (name, year) not in self._short:
            zone, found = self.get(name), {}
            for y in range(max(year - 1, 1), min(year + 1, 9998) + 1):
                for day in range(0, 365, 5):
                    at = (dt.datetime(y, 1, 1) + dt.timedelta(days=day)).replace(tzinfo=zone)
                    found.setdefault(at.tzname().upper(), set()).add(int(at.utcoffset().total_seconds()))
            self._short[name, year] = found
        return self._short[name, year]


def _millis(local: dt.datetime, fraction: str | None, offset: float) -> int:
    whole = int((local - _EPOCH).total_seconds()) - int(offset)
    return whole * 1000 + (int((fraction + "00")[:3]) if fraction else 0)


def _in_zone(local: dt.datetime, fraction: str | None, zone: ZoneInfo) -> tuple[str, int | None]:
    fits = set()
    for fold in (0, 1):
        offset = local.replace(tzinfo=zone, fold=fold).utcoffset()
        try:
            back = (local - offset).replace(tzinfo=dt.timezone.utc).astimezone(zone).replace(tzinfo=None)
        except (OverflowError, ValueError):
            return "impossible", None
        if back.replace(fold=0) == local:
            fits.add(offset.total_seconds())
    if len(fits) == 1:
        return "instant", _millis(local, fraction, fits.pop())
    return ("twice" if fits else "never"), None


def _resolve(g: dict, year: int, month: int, day: int, row_zone: str | None, zones: Zones) -> tuple[str, int | None]:
    hour, minute, second = (int(g.get(k) or 0) for k in ("h", "mi", "s"))
    half = g.get("ap")
    if half:
        if not 1 <= hour <= 12:
            return "impossible", None
        hour = hour % 12 + (12 if half in ("p", "P", "오후") else 0)
    try:
        local = dt.datetime(year, month, day, hour, minute, second)
    except ValueError:
        return "impossible", None
    fraction, offset, named = g.get("f"), g.get("off"), g.get("in") or g.get("name")
    if offset:
        if offset in "Zz":
            return "instant", _millis(local, fraction, 0)
        digits = offset[1:].replace(":", "")
        hours, minutes = int(digits[:2]), int(digits[2:] or 0)
        if hours > 18 or minutes > 59:
            return "impossible", None
        return "instant", _millis(local, fraction, (hours * 3600 + minutes * 60) * (-1 if offset[0] == "-" else 1))
    row_zone = row_zone.strip() if row_zone else None
    if named:
        named = named.strip()
        if named.lower() in _UTC_NAMES:
            return "instant", _millis(local, fraction, 0)
        if "/" not in named:
            offsets = zones.short(row_zone, year).get(named.upper(), set()) if row_zone and zones.get(row_zone) else set()
            return ("instant", _millis(local, fraction, next(iter(offsets)))) if len(offsets) == 1 else ("no_zone", None)
    zone = zones.get(named or row_zone) if named or row_zone else None
    return _in_zone(local, fraction, zone) if zone else ("no_zone", None)


def readings(value: str, row_zone: str | None, zones: Zones, declared: Container[str] = ()) -> list[Reading]:
    """All readings of one written value; those that are no date only of ``declared`` notations, or if there is no other."""
    text = value.strip()
    number, _, fraction = text.partition(".")
    if number.isascii() and number.isdigit() and (not fraction or (len(number) == 10 and fraction.isascii() and fraction.isdigit())):
        n = len(number)
        if n == 8:
            return [("digits_date", *_resolve({}, int(number[:4]), int(number[4:6]), int(number[6:]), row_zone, zones))]
        if n not in _NUMBERS or text.endswith("."):
            return [("digits", "filler", None)]
        unit = _NUMBERS[n]
        return [(f"digits_{n}", "instant", int(number) * unit + int((fraction + "00")[:3] if fraction else 0) if n <= 13 else int(number) // unit)]
    for label, pattern in (("year_first", _YEAR_FIRST), ("compact", _COMPACT), ("year_last", _YEAR_LAST), ("day_month", _DAY_MONTH), ("month_day", _MONTH_DAY), ("korean", _KOREAN)):
        found = pattern.match(text)
        if not found:
            continue
        g = found.groupdict()
        if label == "year_last":
            notation = "slash" if g["sep"] == "/" else "dot"
            both = {"month_first": (int(g["a"]), int(g["b"])), "day_first": (int(g["b"]), int(g["a"]))}
            out = [(f"{notation}_{r}", *_resolve(g, int(g["y"]), m, d, row_zone, zones)) for r, (m, d) in both.items()]
            real = [r for r in out if r[1] != "impossible"]
            return out if notation in declared else real or out[:1]
        month = _MONTH_OF.get(g["mon"].lower()) if "mon" in g else int(g["m"])
        if month is None:
            return [(label, "filler", None)]
        return [(label, *_resolve(g, int(g["y"]), month, int(g["d"]), row_zone, zones))]
    return [("none", "filler", None)]


def fit_mixture(sets: list[tuple[tuple[str, int], ...]], counts: list[int], declared: Container[str] = (), smoothing: float = 0.5, rounds: int = 200) -> dict[str, float]:
    """Mixture weights of the readings of one source from counts of the sets of (reading, fit) its values admit."""
    names = sorted({r for s in sets for r, _ in s})
    likely = np.zeros((len(sets), len(names)))
    for row, s in zip(likely, sets):
        for reading, fit in s:
            row[names.index(reading)] = LIKELIHOOD[fit]
    weight = np.full(len(names), 1 / max(1, len(names)))
    n = np.array(counts, float)
    prior = smoothing + np.array([DECLARED * n.sum() if r in declared else 0.0 for r in names])
    for _ in range(rounds):
        share = likely * weight
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        new = n @ share + prior
        new /= new.sum()
        if np.abs(new - weight).max() < 1e-12:
            break
        weight = new
    return dict(zip(names, weight.tolist()))


_READ = "array<struct<reading:string,state:string,ms:bigint,fit:int>>"


def normalise_instants(values: DataFrame, conventions: dict[str, str] | None = None, confidence: float = 0.95) -> DataFrame:
    """``values(id, field_name, source, tz, value)`` -> (id, field_name, value, reading, state, posterior, utc_ms).

    ``conventions`` may declare ``slash`` and ``dot`` as ``month_first`` or
    ``day_first``; without, the mixtures of the sources decide.  A column ``seen_ms`` may
    give the time at which the value was received.
    """
    declared = dict(conventions or {})
    favoured = {f"{notation}_{reading}" for notation, reading in declared.items()}
    struct = pa.struct([("reading", pa.string()), ("state", pa.string()), ("ms", pa.int64()), ("fit", pa.int32())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zones = Zones()
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (4, 3, 5)))
            read = [[{"reading": r, "state": s, "ms": m, "fit": fit_of(s, m, seen)} for r, s, m in readings(v, z, zones, declared)] for v, z, seen in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(read, pa.list_(struct))], names=["id", "field_name", "source", "value", "readings"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [tuple((r, int(f)) for r, _, f in (x.rpartition("|") for x in s)) for s in pdf["names"]]
        weights = fit_mixture(sets, pdf["n"].tolist(), favoured)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "reading": list(weights), "weight": list(weights.values())})

    seen = (F.col("seen_ms") if "seen_ms" in values.columns else F.lit(None)).cast("long").alias("seen_ms")
    plain = values.select(F.col("id").cast("long").alias("id"), "field_name", "source", "tz", "value", seen).filter(F.col("value").isNotNull())
    parsed = materialise(spread(plain).mapInArrow(parse, f"id long, field_name string, source string, value string, readings {_READ}"), "readings")
    names = F.array_sort(F.transform("readings", lambda r: F.concat(r["reading"], F.lit("|"), r["fit"].cast("string"))))
    mixtures = parsed.groupBy("source", names.alias("names")).agg(F.count(F.lit(1)).alias("n")).groupBy("source").applyInPandas(fit, "source string, reading string, weight double")
    chosen = _judged(parsed, mixtures, confidence)
    return chosen.select("id", "field_name", "value", F.col("r.reading").alias("reading"), F.col("r.state").alias("state"), "posterior", F.col("r.ms").alias("utc_ms"))


def _judged(parsed: DataFrame, mixtures: DataFrame, confidence: float) -> DataFrame:
    """Weigh the readings of every value by the mixture of its source."""
    weights = mixtures.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("reading", "weight"))).alias("weights")).withColumnRenamed("source", "of")
    joined = parsed.join(weights, F.col("source").eqNullSafe(F.col("of")))
    share = lambda r: F.col("weights")[r["reading"]] * F.array(*map(F.lit, LIKELIHOOD))[r["fit"]]
    total: Column = F.aggregate("readings", F.lit(0.0), lambda a, r: a + share(r))
    best = F.array_max(F.transform("readings", lambda r: F.struct((share(r) / total).alias("posterior"), r.alias("r"))))
    same = F.size(F.array_distinct(F.transform("readings", lambda r: F.struct(r["state"], r["ms"])))) == 1  # all readings mean the same
    return joined.select("id", "field_name", "value", best.alias("best"), same.alias("same")).select(
        "id",
        "field_name",
        "value",
        F.when(F.col("same"), 1.0).otherwise(F.col("best.posterior")).alias("posterior"),
        F.when(F.col("same") | (F.col("best.posterior") >= confidence), F.col("best.r")).otherwise(F.struct(F.col("best.r.reading").alias("reading"), F.lit("unresolved").alias("state"), F.lit(None).cast("long").alias("ms"), F.col("best.r.fit").alias("fit"))).alias("r"),
    )


def inbound_values(facts: DataFrame, conventions: dict[str, str] | None = None) -> DataFrame:
    """``normalise_instants`` of all times of inbound facts, the agents being the sources."""
    fields = ("occurred_start", "event_date", "mentioned_at")
    written = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    values = facts.select(F.col("fact_id").alias("id"), F.col("agent").alias("source"), "tz", F.unix_millis(F.col("received_at").cast("timestamp")).alias("seen_ms"), written.alias("w"))
    values = values.select("id", F.col("w.field_name").alias("field_name"), "source", "tz", F.col("w.value").alias("value"), "seen_ms")
    return normalise_instants(values, conventions)


def inbound_instants(facts: DataFrame) -> DataFrame:
    """(fact_id, field_name, utc_ms) of the values of inbound facts that denote exactly one instant."""
    found = inbound_values(facts, {"slash": "month_first", "dot": "day_first"})
    return found.filter("state = 'instant'").select(F.col("id").alias("fact_id"), "field_name", "utc_ms")
