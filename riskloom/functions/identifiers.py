"""Normal form of advisory identifiers, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, with the invisible characters that editors leave around a text.
BLANKS = r"[\s\p{Z}\x{00}-\x{1F}\x{85}\x{180E}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
#: Every character that is set as a dash.
DASHES = r"[\p{Pd}\x{AD}\x{2D7}\x{2043}\x{2212}\x{2796}]"
#: The identifier schemes and the form of their parts.
SCHEMES = r"^(CVE-[0-9]{4}-[0-9]{4,}|GHSA(-[0-9A-Z]{4}){3}|(PYSEC|GO|RUSTSEC)-[0-9]{4}-[0-9]+)\z"
#: Well-formed texts that name no advisory: year or number of zeros, or only filler letters.
STAND_INS = r"^([A-Z]+-0{4}-.*|[A-Z]+-[0-9]{4}-0+|GHSA(-X{4}){3}|GHSA(-0{4}){3})\z"


def trimmed(text: Column) -> Column:
    """``text`` without white space or invisible characters at either end."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def normal_form(text: Column) -> Column:
    """Upper case, no white space around it, parts joined by ``-``; null for a text that names no advisory."""
    # most identifiers are plain ones of the commonest scheme and need none of the slower steps
    common = text.rlike(r"^CVE-[0-9]{4}-[0-9]{4,}\z") & (F.substring(text, 5, 4) != "0000") & (F.translate(F.substring(text, 10, 1000), "0", "") != "")
    plain = text.rlike(r"^(CVE|GHSA|PYSEC|GO|RUSTSEC)-[0-9A-Za-z-]+\z")
    clean = F.upper(F.when(plain, text).otherwise(F.regexp_replace(trimmed(text), DASHES, "-")))
    return F.when(common, text).when(clean.rlike(SCHEMES) & ~clean.rlike(STAND_INS), clean)


# The same in SQL for a column ``x``, with patterns of its own.
SQL_NORM = r"upper(regexp_replace(regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\p{Pd}\x{2212}]', '-', 'g'))"
_SCHEMES = "^(CVE-[0-9]{4}-[0-9]{4,}|GHSA(-[0-9A-Z]{4}){3}|(PYSEC|GO|RUSTSEC)-[0-9]{4}-[0-9]+)$"
SQL_IS_ID = f"regexp_matches({SQL_NORM}, '{_SCHEMES}') and not regexp_matches({SQL_NORM}, '^[A-Z]+-0000-|-[0-9]{{4}}-0+$')"
