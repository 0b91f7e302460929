"""Reading of timestamp texts of many shapes.

The texts are read by an Arrow-batched function: the same rules as column expressions need some forty dependent
fields, for which Spark generates code beyond the JVM's method size and then falls back to interpretation. What
follows the reading (zones, offsets, instants) is JVM-side. Nothing depends on the session's time zone.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000

#: Zone abbreviations and their own offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "SAST": 120, "CAT": 120, "EAT": 180, "WAT": 60, "PKT": 300, "IST": 330, "NPT": 345, "ICT": 420, "WIB": 420,
    "HKT": 480, "SGT": 480, "PHT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "BRT": -180, "ART": -180,
    "EST": -300, "EDT": -240, "COT": -300, "PET": -300, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

_MON = r"(?P<mon>JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEPT?(?:EMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)\.?"
_DOW = r"(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*\.?,? +)?"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<us>\d+))?)?(?: ?(?P<half>[AP])\.?M\.?(?![A-Z]))?"
_ZONE = r" ?(?P<zone>[A-Z]{1,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?(?: ?\[[^\]]*\])?|Z ?\[[^\]]*\]|[A-Z_]+(?:/[A-Z0-9_+-]+)+)?"
_TIME = rf"(?:(?:[T ]| ?, ?| AT ) *{_CLOCK}{_ZONE})?"

#: Shapes of cleaned upper-case texts in the order they are tried.
SHAPES = [
    re.compile(x, re.A)
    for x in (
        rf"(?P<y>\d{{4}})([-/.])(?P<m>\d{{1,2}})\2(?P<d>\d{{1,2}}){_TIME}",
        rf"(?P<p>\d{{1,2}})/(?P<q>\d{{1,2}})/(?P<y>\d{{4}}){_TIME}",
        rf"(?P<d>\d{{1,2}})([.-])(?P<m>\d{{1,2}})\2(?P<y>\d{{4}}){_TIME}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:T?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<us>\d+))?)?{_ZONE})?",
        rf"(?P<y>\d{{4}})-?W(?P<w>\d{{2}})-?(?P<wd>\d){_TIME}",
        rf"(?P<y>\d{{4}})-(?P<yd>\d{{3}}){_TIME}",
        rf"{_DOW}(?P<d>\d{{1,2}})(?:ST|ND|RD|TH|\.)?[ -]{_MON}[ ,-] ?(?P<y>\d{{4}}){_TIME}",
        rf"{_DOW}{_MON} +(?P<d>\d{{1,2}})(?:ST|ND|RD|TH)?,? +(?P<y>\d{{4}}){_TIME}",
        rf"{_DOW}{_MON} +(?P<d>\d{{1,2}}) +{_CLOCK} +(?:(?P<zone>[A-Z]{{1,5}}|[+-]\d{{2}}:?\d{{2}}) +)?(?P<y>\d{{4}})",
        rf"{_DOW}{_MON} +(?P<d>\d{{1,2}}) +{_CLOCK} +(?P<y>\d{{4}}){_ZONE}",
    )
]
_COUNT = re.compile(r"([+-]?)(\d{1,17})(?:\.(\d*))?", re.A)
_NO_COUNT = re.compile(r"\d{8}|\d{12}|\d{14}", re.A)
_OFFSET = re.compile(r"(?:UTC|GMT)?([+-])(\d{1,2}?):?(\d{2})?(?: ?\[.*)?", re.A)
_REGION = re.compile(r"[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+$", re.A)
_EDGES = "".join(map(chr, (*range(33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
_DASHES = dict.fromkeys(map(ord, "\u2010\u2011\u2012\u2013\u2014\u2212\ufe63\uff0d"), "-")
_EPOCH = datetime.date(1970, 1, 1).toordinal()


def read_text(text: str | None, order: str | None):
    """``(count_us, local_us, offset_min, region)`` of a timestamp text, or None if it is none.

    ``count_us``: instant of a bare count since 1970, whose unit follows from its size. ``local_us``: local date and
    time as microseconds since 1970-01-01 00:00 of that clock. ``offset_min``: offset written in the text.
    ``region``: zone name written in the text. Impossible dates, times and offsets make it no timestamp.
    """
    if text is None:
        return None
    clean = text.strip(_EDGES)
    if not clean:
        return None
    if not clean.isascii():
        clean = clean.translate(_DASHES)
    clean = " ".join(clean.split())
    if (m := _COUNT.fullmatch(clean)) and not _NO_COUNT.fullmatch(clean):
        sign, whole, part = m.groups()
        n, part = int(whole), part or ""
        if len(whole) <= 11:
            n = n * 1_000_000 + int(part[:6].ljust(6, "0"))
        elif len(whole) <= 14:
            n = n * 1_000 + int(part[:3].ljust(3, "0"))
        return (-n if sign == "-" else n), None, None, None
    up = clean.upper()
    for shape in SHAPES:
        if m := shape.fullmatch(up):
            break
    else:
        return None
    g = m.groupdict()
    try:
        y = int(g["y"])
        if g.get("w"):
            date = datetime.date.fromisocalendar(y, int(g["w"]), int(g["wd"]))
        elif g.get("yd"):
            date = datetime.date(y, 1, 1) + datetime.timedelta(int(g["yd"]) - 1)
            if date.year != y:
                return None
        elif g.get("p"):
            # all numbers and slashes: as the origin writes them; if it writes the year first, as they can be read
            p, q = int(g["p"]), int(g["q"])
            month_first = order == "mdy" or order != "dmy" and p <= 12
            date = datetime.date(y, p, q) if month_first else datetime.date(y, q, p)
        else:
            date = datetime.date(y, int(g["m"]) if g.get("m") else MONTHS.index(g["mon"][:3]) + 1, int(g["d"]))
    except (ValueError, OverflowError):
        return None
    h, mi, s = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if half := g.get("half"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half == "P" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    local = (((date.toordinal() - _EPOCH) * 24 + h) * 60 + mi) * 60 + s
    local = local * 1_000_000 + int((g.get("us") or "")[:6].ljust(6, "0"))
    zone = g.get("zone")
    if not zone:
        return None, local, None, None
    if zone[0] == "Z" and (len(zone) == 1 or "[" in zone):
        return None, local, 0, None
    if o := _OFFSET.fullmatch(zone):
        hh, mm = int(o[2]), int(o[3] or 0)
        if hh > 18 or mm > 59:
            return None
        return None, local, (hh * 60 + mm) * (-1 if o[1] == "-" else 1), None
    if "/" in zone:
        r = _REGION.search(clean)
        return (None, local, None, r[0]) if r else None
    if zone in ABBREVIATIONS:
        return None, local, ABBREVIATIONS[zone], None
    return None


READ = T.StructType(
    [T.StructField("count_us", T.LongType()), T.StructField("local_us", T.LongType()), T.StructField("offset_min", T.LongType()), T.StructField("region", T.StringType())]
)


@F.arrow_udf(READ)
def read_texts(text, order):
    """Struct of ``read_text`` for each text; all null where the text is no timestamp."""
    import pyarrow as pa

    empty = (None, None, None, None)
    rows = [read_text(t, o) or empty for t, o in zip(text.to_pylist(), order.to_pylist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in READ])


def zone_names(spark: SparkSession) -> list[str]:
    """The zone names the JVM knows; a text that names another one is no timestamp."""
    return sorted(str(x) for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def to_utc_micros(local_us: Column, zone: Column) -> Column:
    """Local time in a named zone to UTC: the earlier instant of two, a skipped time by the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))
