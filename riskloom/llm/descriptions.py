"""Which description texts say something, as JVM-side column expressions.

A text says nothing if, as a whole, it is blank, a stand-in word, an unfilled slot, an announcement that the text
will come or is withheld, or a pointer to another place. A text that only begins or ends with such words is usable,
and so is one of more than ``STAND_IN_CHARS`` characters: the patterns take too long on texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A stand-in is no longer than this, marks at its ends aside.
STAND_IN_CHARS = 160

_INVISIBLE = r"[\p{Cf}\p{Cc}\s\p{Z}]+"
#: What a description may be called.
_NOUN = (
    r"(?:(?:an?|the|this|any|some|more|full|further|additional|complete|long|short|detailed|technical|vulnerability|advisory|cve|issue|bug|flaw|und|weitere[rn]?|eine?) )*"
    r"(?:descriptions?|details?|summary|summaries|text|info|information|content|body|abstract|explanation|analysis|overview|report|write-?up|notes?|entry|record|data|documentation|beschreibung|einzelheiten|zusammenfassung|angaben|details|resumen|descripción|detalles|résumé|détails)"
)
#: Whole texts that stand in for one, without case, marks and blanks at their ends.
_WORDS = (
    r"n/?a|n\.a|na|none|null|nil|nan|undefined|unknown|unspecified|empty|blank|missing|pending|tb[acd]|to ?do|fix ?me|wip|placeholder|reserved|redacted|withheld|restricted|embargoed|draft|test|x{2,}|not (?:yet )?(?:available|known|assigned|provided|specified|set|given|public|disclosed|applicable)"
    r"|coming soon|to follow|see (?:above|below)|as above|ditto|lorem ipsum.*|unbekannt|keine?(?: angabe| beschreibung)?|folgt|sin descripción|aucune description"
    r"|to be (?:announced|determined|defined|decided|added|written|provided|completed|confirmed|disclosed|published|filled in|supplied|done)"
    r"|(?:awaiting|undergoing|pending|under|in) (?:re)?(?:analysis|review|triage|assessment|publication|disclosure|embargo|investigation)"
)
_WHEN = (
    r"(?:is|are|was|were|has|have|had|been|be|will|shall|to|can|could|currently|still|yet|soon|shortly|later|not|for|now|at|this|time|the|moment|wird|werden|noch|bald|in|kürze|nach"
    r"|pending|missing|follows?|coming|added|available|unavailable|withheld|forthcoming|come|tb[acd]|here|provided|published|announced|disclosed|given|supplied|written|redacted|restricted|embargoed|required|needed|empty|unknown|folgt|folgen|nachgereicht|ergänzt|fehlt|fehlen)"
)
_LATER = rf"{_WHEN}(?: {_WHEN})*"
_WHERE = r"(?:references?|links?|urls?|pages?|websites?|sites?|vendor|advisory|advisories|bulletins?|notices?|above|below|changelog|release notes?|commits?|upstream|tracker|tickets?|issues?|reports?|details|attachments?|documents?|original|source|post|announcement)"
_POINT = r"(?:please |kindly |for (?:more |further )?(?:details|information|a description),? )?(?:see|refer to|cf\.?|check|consult|read|visit|follow|go to|details (?:at|in|under)|described (?:at|in)|more (?:info |information |details )?(?:at|in|under)|siehe|vgl\.?|voir|véase|ver)"
_SLOT_NAME = r"[\w .,:|/'-]{1,60}"
#: Whole texts that are one slot of a template language.
_SLOTS = "|".join(
    (
        rf"\{{+ ?[%#]?-? ?{_SLOT_NAME}-? ?[%#]? ?\}}+", rf"[$#@%]\{{+{_SLOT_NAME}\}}+", rf"\$\({_SLOT_NAME}\)", rf"%\({_SLOT_NAME}\)[sdifr]?", rf"(?:%|%%|\$|\$\$|@|@@|#|##|:){_SLOT_NAME}(?:%|%%|\$\$?|@|@@|#|##|:)",
        rf"_+{_SLOT_NAME}_+", rf"<+[%?]?=? ?{_SLOT_NAME}[%?]?>+", rf"\[+{_SLOT_NAME}\]+", rf"«{_SLOT_NAME}»", r"&[a-z_]{3,30};", r"xx+[a-z]{3,20}xx+", rf"(?:todo|tbd|fixme)(?:\({_SLOT_NAME}\)|: ?(?:write|add|insert|enter|fill in|provide|describe)? ?(?:{_NOUN})?(?: here)?)",
        r"\$[a-z_]{3,30}", r"%[a-z_]{3,30}",
    )
)


#: Whole texts that stand in for a description, without marks at their ends.
_WHOLE = (
    rf"^(?:{_WORDS}|(?:no|without|keine?|aucune?|sin) {_NOUN}(?: {_LATER})?|{_NOUN}(?: {_LATER})?(?: here)?|{_LATER}"
    rf"|(?:write|add|insert|enter|fill in|provide|describe|put|type) .{{0,20}}(?:{_NOUN}|here)(?: here)?|{_NOUN} goes here"
    rf"|(?:this |the )?(?:entry|record|candidate|identifier|id|number|cve|advisory|text) (?:is|has been|was) (?:a placeholder|reserved|assigned|rejected|withdrawn|empty|under review|a stub).{{0,60}}"
    rf"|(?:reserved|rejected?|disputed|withdrawn)[^\p{{L}}]+(?:{_NOUN})?(?: {_LATER})?(?: .{{0,5}})?"
    rf"|{_POINT} (?:(?:the|our|their|its|this|that|an?|following|attached|linked|official|vendor|vendor's|project|full|original|upstream) )*{_WHERE}(?: (?:{_WHERE}|for|more|further|details|information|info|a|the|description|page|below|above|of|vendor))*"
    rf"|(?:{_POINT}:? )?(?:https?://|www\.)\S+(?: (?:and )?(?:https?://|www\.)\S+)*"
    rf"|(?:cve|ghsa|pysec|go|rustsec)-[\w-]+)$"
)
_SLOT = rf"^[^\p{{L}}\p{{N}}<>\[\]{{}}%$@#_&«»]*(?:{_SLOTS})[.!]?$"
_ENDS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def says_something(text: Column) -> Column:
    """True if ``text`` is a usable description; false for null."""
    flat = F.trim(F.regexp_replace(F.lower(text), _INVISIBLE, " "))
    bare = F.regexp_replace(flat, _ENDS, "")
    few = F.length(bare) <= STAND_IN_CHARS
    return F.coalesce((bare != "") & ~(few & (bare.rlike(_WHOLE) | flat.rlike(_SLOT))), F.lit(False))


def sql_says_something(x: str) -> str:
    """The same as SQL text."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    flat = f"trim(regexp_replace(lower({x}), {q(_INVISIBLE)}, ' ', 'g'), ' ')"
    bare = f"regexp_replace({flat}, {q(_ENDS)}, '', 'g')"
    return f"coalesce({bare} <> '' and not (length({bare}) <= {STAND_IN_CHARS} and (regexp_matches({bare}, {q(_WHOLE)}) or regexp_matches({flat}, {q(_SLOT)}))), false)"
