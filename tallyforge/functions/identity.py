"""Normalisation and content identity of turns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A whole number of anything: text and fractions are cut, all else is 0."""
    return F.coalesce(x.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def _key(prefix: str, *parts: Column) -> Column:
    """A hash of all parts; a null part counts as the text None, as concat_ws would skip it."""
    return F.concat(F.lit(f"{prefix}:"), F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))))


def session_scoped_id(prefix: str, session: Column, model: Column, i: Column, o: Column, cr: Column) -> Column:
    """Identity of a turn whose copies stay within a session."""
    return _key(prefix, session, model, i, o, cr)


def content_id(prefix: str, uuid: Column, model: Column, i: Column, o: Column, cw: Column, cr: Column) -> Column:
    """Identity of a turn that is copied into other sessions: without cache tokens it is too weak, and the sender's own id stays."""
    return F.when((F.coalesce(cw, F.lit(0)) != 0) | (F.coalesce(cr, F.lit(0)) != 0), _key(prefix, model, i, o, cw, cr)).otherwise(uuid)


def written_for_an_hour(h1: Column, m5: Column, cw: Column, never: Column) -> Column:
    """Cache writes for an hour: as told, else what the five-minute ones leave, else 0 where there are never any, else unknown."""
    return F.coalesce(h1, F.when(m5.isNotNull(), F.greatest(F.lit(0), cw - m5)), F.when(never, 0))


def surface(x: Column, names: dict[str, str]) -> Column:
    """other:<raw> is named by its first known part; all else stays."""
    known = F.create_map(*(F.lit(y) for kv in names.items() for y in kv))
    parts = F.transform(F.split(F.substring(x, 7, 1 << 20), r"[_\-\s]"), lambda p: known[F.lower(p)])
    return F.when(x.startswith("other:"), F.coalesce(F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0)), x)).otherwise(x)


def token_measures(i: Column, o: Column, cw: Column, cr: Column) -> dict[str, Column]:
    i, o, cw, cr = (F.coalesce(x, F.lit(0)) for x in (i, o, cw, cr))
    return {"io": i + o, "billable": i + o + cw, "total": i + o + cw + cr}


def local_day(ts: Column, offset_s: int = 32400) -> Column:
    """The day (yyyy-MM-dd) of epoch milliseconds at a fixed offset, whatever the session's zone."""
    return F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), F.floor((F.floor(ts / 1000) + offset_s) / 86400).cast("int")), "yyyy-MM-dd")


def midnight(day: str, offset_s: int = 32400) -> int:
    """Epoch milliseconds of a day's (yyyy-MM-dd) beginning at a fixed offset."""
    return int((datetime.fromisoformat(day) - datetime(1970, 1, 1)).total_seconds() - offset_s) * 1000


def millis_of(iso: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 time; without an offset it is UTC, and null if it is no time."""
    zoned = F.when(iso.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def glob(pattern: Column) -> Column:
    """A regular expression for a glob with *, ?, [characters and ranges] and [!...], over all characters; a bracket that is not closed stands for itself."""
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)\[!?+\]?+[^\]]*+\]|."), F.lit(0))

    def one(x: Column) -> Column:
        own = F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"([\\\[\]^&])", r"\\$1")
        chosen = F.when(own.startswith("!"), F.concat(F.lit("[^"), F.substring(own, 2, 2**31 - 1), F.lit("]"))).otherwise(F.concat(F.lit("["), own, F.lit("]")))
        quoted = F.regexp_replace(x, r"([\\.\[\]{}()+^$|])", r"\\$1")
        return F.when(x == "*", ".*").when(x == "?", ".").when(F.length(x) > 1, chosen).otherwise(quoted)

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(parts, one), ""), F.lit(r"\z"))
