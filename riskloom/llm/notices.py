"""Residue that a text shows by itself: marks of known template languages, and pages of nothing but known notices.

What these rules know are fixed values, in several languages. Phrasings they don't know are left to the rules of
``templates``, which need no list but several documents of one template.
"""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

from riskloom.llm.residue_text import FENCE, SENTENCE, TAG_SLOT, TICKS, UNSEEN, closed_or_known, is_code, spaced

_NAME = r"[A-Za-z][A-Za-z0-9_]*(?:[ .-][A-Za-z0-9_]+){0,4}"
#: Marks of template languages around a name.
_SLOT = re.compile(
    "|".join(
        (
            rf"\{{\{{[#/^>&]? ?{_NAME} ?(?:\|[^{{}}\n]{{1,30}})?\}}\}}", rf"[$#]\{{ ?{_NAME} ?\}}", rf"<%[=-]? ?{_NAME} ?-?%>", rf"\{{% ?{_NAME} ?%\}}", rf"%\({_NAME}\)[sdifr]", rf"\[\[ ?{_NAME} ?\]\]",
            rf"@@{_NAME}@@", rf"\$\${_NAME}\$\$", r"(?<![\w%])%[A-Za-z_]{2,30}%(?![\w%])", r"(?<!\w)__[A-Z][A-Z_]+__(?!\w)", r"(?<!\w)XX[A-Za-z_]{2,30}XX(?!\w)", r"«[A-Za-z_]{2,30}»", r"(?<![\w$#{])\{[A-Za-z_]{2,30}\}(?!\})",
            r"(?<!\w)TODO\([A-Za-z_ ]{2,30}\)(?!:)", rf"\[(?:insert|enter|add|put|type|fill in|your|please) {_NAME}(?: here)?\]", rf"\[{_NAME} here\]", r"<<[A-Za-z_ ]{2,30}>>", r"(?<![\w<])<(?:insert|your|enter) [A-Za-z_ ]{2,30}>",
        )
    ),
    re.I,
)
#: What every mark of ``_SLOT`` begins with.
_SLOT_SIGN = re.compile(r"\{[{%A-Za-z_]|[$#]\{|<[%<A-Za-z]|%[(A-Za-z_]|\[|@@|\$\$|__[A-Za-z]|XX|xx|Xx|xX|«|TODO\(|todo\(|Todo\(", re.A)
_ENTITY_SLOT = re.compile(r"&([A-Za-z_]{2,30});")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_HTML = re.compile(r"</?[a-zA-Z][\w-]*(?: [^<>\n]{0,300})?/?>|<[!?][^<>\n]{0,300}>")
_QUOTED = re.compile(r"\"[^\"\n]{3,}\"|“[^”\n]{3,}”|(?<!\w)'[^'\n]{4,}'(?!\w)|‘[^’\n]{4,}’")

#: Page headers and footers, those with bars aside.
_EDGE = re.compile(
    r"^(?:skip to .{3,30}|menu\W*|navigation|search|sign in|log ?in|© .{1,80}|\(c\) .{1,80}|copyright .{1,80}|all rights reserved\.?|page generated in .{1,30}|powered by .{1,40}|choose a language.{0,80}|we (?:count visits with|use) cookies.{0,80}|accept|decline|back to top|home|.{1,60} - project pages|generated .{1,40}|last updated.{0,40}|(?:[-*•>+] ?)?[@\w][\w@./:-]*)$"
)

_SCRIPT = r"(?:java ?script|js|client-side code|ecma ?script|scripts?|scripting|active content|cookies?|browser)"
#: Sentences that stand in place of content, in lower case and single blanks, marks at their ends aside.
_ANCHORS = re.compile(
    "|".join(
        (
            # scripts, cookies, another browser
            rf"(?:please |you (?:need|have|must|will need)(?: to)? |(?:kindly|first) |to (?:use|view|see|open) .{{2,60}} )?(?:enable|allow|turn on|switch on|activate|permit|accept|unblock|update|upgrade|use) (?:a |an |your |the |another |newer |modern |supported )*{_SCRIPT}\b.{{0,120}}",
            rf"(?:your |this |the )?{_SCRIPT}(?: and {_SCRIPT})? (?:is|are|has been|have been|have to be|must be|needs to be|need to be|seems?|appears?|may be) (?:currently )?(?:not |un|no longer )?(?:too old|out of date|outdated|supported|disabled|off|on|enabled|switched off|turned off|blocked|required|needed|missing|unsupported|active|allowed)\b.{{0,120}}",
            rf".{{1,60}} (?:needs?|requires?|(?:does|do|will|can) ?not (?:work|run|load|start|open|display)(?: properly)? without|relies on|depends on) (?:\w+ )?{_SCRIPT}\b.{{0,60}}", rf"(?:we )?(?:could|can) ?not (?:display|show|start|open|load|render|run) .{{2,60}}: .{{0,40}}{_SCRIPT}\b.{{0,60}}",
            r"(?:the|this|most|some|all|many|nothing|parts of)(?: [\w-]+){0,4} (?:will|may|can) ?(?:not (?:load|work|open|show|display|be (?:shown|displayed|loaded|available|visible)).{0,80}|(?:stay|be|remain) (?:hidden|blank|empty|unavailable|invisible|broken).{0,80})", r"checking your browser.{0,120}|(?:verifying|checking) (?:that )?you are (?:a )?human.{0,60}|prove (?:that )?you are (?:a )?human.{0,120}|(?:please )?(?:complete|solve) the (?:captcha|challenge).{0,60}",
            r"this (?:happens on its own|process is automatic|check is automatic).{0,80}", r"loading\W*|please wait\W*|one moment\W*|redirecting.{0,60}", rf"if nothing (?:shows up|appears|happens|loads).{{0,120}}",
            r".*(?:aktivieren sie|schalten sie|erlauben sie|benötigt|erfordert) .{0,30}(?:javascript|cookies|skripte).{0,100}|.*(?:activer|activez|autoriser|autorisez|nécessite) .{0,20}(?:javascript|cookies|scripts).{0,100}|.*(?:active|activar|habilite|habilitar|permita|requiere) .{0,20}(?:javascript|cookies).{0,100}|.*(?:включите|разрешите|требуется) .{0,20}(?:javascript|cookies|скрипты).{0,100}|.*javascript ?を(?:有効|オン).{0,60}|.*(?:启用|开启|打开|允许) ?javascript.{0,60}|.*(?:ative|abilita|attiva|habilite) (?:o |il )?javascript.{0,80}",
            # errors and refusals
            r"(?:http |error:? |error code:? |status:? |fehler:? |erreur:? |ошибка:? |エラー:? |错误:? )?[45]\d\d\b(?:[ :—–-]{1,3}[\w' ,-]{2,60})?", r"(?:error|fehler|erreur|ошибка|エラー|错误)(?: [45]\d\d)?", r"(?:not found|page not found|file not found|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|gone|access denied|permission denied|request (?:blocked|denied|timed out)|method not allowed|unavailable|(?:temporarily|currently) unavailable|server error|connection (?:refused|reset|timed out))",
            r"(?:the )?requested (?:address|page|url|resource|file|document|path)\b.{0,120}", r"(?:(?:we are |we're |i am )?(?:very )?sorry|whoops|oops|uh-oh|h+m+|oh no)\b.{0,120}", r"(?:the|this|that|your) (?:page|file|entry|document|site|address|url|link|resource|article|item|repository|package|release|project|tracker|registry|issue|record|backend|server|service|database|upstream|gateway|system|origin|host|proxy|node|cluster|application|app|mirror|edge) (?:you (?:requested|are looking for|wanted) )?(?:is|are|was|has|have|had|may|might|could|can|cannot|can't|does|did|do|sent|timed|took|returned|answered|closed|reset|refused|dropped|no longer)\b (?:not |been |be |no longer |currently |temporarily |now )*(?:gone|moved|removed|deleted|found|loaded|displayed|shown|available|unavailable|reachable|accessible|shown|served|exist|exists|opened|down|overloaded|busy|offline|private|respond|responding|answer|answered|out|too long|an? (?:empty|invalid|bad|unexpected) (?:reply|response|answer)|the (?:connection|stream|request)|an error|a problem|under maintenance|being updated|restarting)\b.{0,80}",
            r"it may be private.{0,80}|(?:you )?(?:may |might )?(?:have|need) to (?:sign|log) in (?:first|again).{0,60}|sign in again.{0,60}|(?:please )?(?:sign|log) in to (?:continue|see|view).{0,60}|your session (?:has )?(?:expired|ended|timed out).{0,60}", r"your request (?:was|has been) (?:blocked|denied|refused|rejected).{0,80}|(?:you|your (?:ip|client|address|account)) (?:have|has|are|is|do|does) (?:not |been )*(?:blocked|banned|denied|permitted|allowed|authorized|have (?:access|permission)).{0,80}|if you (?:think|believe) this is (?:a mistake|an error|wrong).{0,140}|(?:you do not|you don't) have (?:access|permission).{0,80}",
            r"rate limit (?:was |has been )?(?:exceeded|reached|hit).{0,120}|(?:too many|quota) .{0,40}(?:exceeded|reached)", r"(?:we )?(?:could|can) ?not (?:connect|find|load|open|reach|display|process|complete|handle|serve)\b.{0,80}|(?:failed|unable) to (?:load|connect|fetch|open|render|display|reach)\b.{0,60}|an? (?:unexpected |internal |unknown )?error (?:has )?occurr?ed.{0,80}|something (?:went|has gone) wrong.{0,60}|we are working on it.{0,40}|our team has been (?:told|notified|informed).{0,40}", r"retry (?:after|in) \d+.{0,40}|(?:please )?(?:try|check) (?:again|the search|later|the address)\b.{0,60}|(?:please )?(?:go|head|return|get) back(?: to .{2,40})?|(?:please )?wait \d+ ?(?:s|seconds?|minutes?)\b.{0,40}|(?:next (?:attempt|try)|reload(?:ing)?|retrying) in .{1,30}|use the (?:menu|search)\b.{0,40}|(?:trace|reference|ref|request id|incident|ray id|id)[ :=]+[0-9a-f-]{6,}|\(?(?:id|ref|trace|code)[ =:]+[0-9a-f]{4,}\)?|\[[0-9a-f]{4,}\]|the (?:site|server|service|system) is (?:down|offline|being|under|closed)\b.{0,60}|(?:scheduled|planned|down for) maintenance.{0,60}",
            r".*(?:konnte|kann) nicht (?:gefunden|geladen|angezeigt) werden.{0,60}|zurück zur startseite|.*n'existe pas ou a été (?:déplacée|supprimée).{0,40}|.*(?:page|ressource) (?:introuvable|demandée).{0,60}|.*(?:página|recurso) (?:no (?:encontrad[ao]|existe)|que busca).{0,60}|.*(?:страница|ресурс) (?:не найден[ао]?|не существует|удален[ао]?).{0,60}|.*(?:ページ|アドレス).{0,20}(?:見つかりません|存在しません|ご確認ください).{0,40}|.*(?:页面|网页|地址).{0,20}(?:不存在|找不到|未找到|已删除).{0,40}|acceso denegado.{0,60}|accès refusé.{0,60}|zugriff verweigert.{0,60}|доступ запрещ[её]н.{0,60}",
            r"\{ ?\"?(?:status|error|code|message|errors|detail|ok|success)\"? ?:.{0,400}(?:error|status|message|denied|missing|not found|false|[45]\d\d).{0,300}\}", r"traceback \(most recent call last\):|file \"[^\"]+\", line \d+.{0,80}|(?:return|raise) \w+.{0,80}|\w*(?:error|exception)(?:: .{0,120})?|at [\w.$<>]+\(.{0,80}\)|.*\[object object\].{0,120}|.*undefined undefined.{0,120}|(?:undefined|null|nan|invalid date)(?: (?:undefined|null|nan|invalid date))*|(?:slowdown|accessdenied|nosuchkey|expiredtoken|internalerror|nosuchbucket|invalidaccesskeyid|requesttimeout|signaturedoesnotmatch)\b.{0,120}|(?:edge|nginx|apache|cloudfront|openresty)/?[\d.]*",
            # filler
            r"lorem ipsum.{0,400}", r"(?:this is )?(?:some |a )?(?:sample|dummy|example|placeholder|filler|test) (?:text|paragraph|content|page)\b.{0,60}|replace this (?:paragraph|text|section|page|line|content)\b.{0,80}|(?:your|the) (?:text|content|title|heading|headline|description) (?:goes )?here|.{0,60}\bgo(?:es)? here|.*(?:blindtext|platzhaltertext|mustertext|beispieltext).{0,80}|hier entsteht .{0,80}|.*texte (?:provisoire|factice|d'exemple|de remplissage).{0,80}|.*texto (?:de relleno|provisional|de ejemplo|de muestra).{0,80}|.*ここに.{1,20}(?:が入ります|を入力|を書いて).{0,20}|.*(?:此处|这里)(?:填写|输入|添加|放置|是占位).{0,40}|.*(?:占位文本|示例文本).{0,40}|.*(?:текст-заполнитель|здесь будет|пример текста|текст появится).{0,60}",
            r"(?:page |site |this (?:page|site|section) is )?(?:still )?(?:under construction|coming soon|work in progress)\W*|(?:content|details|text|more|description|documentation) (?:to follow|coming soon|will follow|to come|follows)\W*|nothing (?:here|to see)(?: here)?(?: yet)?\W*|(?:watch|check) (?:this space|back soon|back later)\W*|(?:to be|tb[acd]\b).{0,30}",
            # forms nobody filled in
            r"[\w .,()/-]{2,40}:(?: ?(?:tb[acd]|to ?do|fix ?me|n/?a|none|unknown|-+|\?+|\.{2,}|…|_+|x{2,}|\[[^\]]{0,40}\]|<[^>]{0,40}>|\([^)]{0,20}\)))?", r"(?:\d+[.)]|[-*+]|\[ ?\]|[-*+] \[ ?\].{0,80})", r"\[(?:your|please|insert|enter|describe|add|fill|e\.g\.|for example|optional|name|date|title|x|link|url|version|complete).{0,80}\]", r"an? (?:short|clear|brief|concise|detailed|one-|few)[\w ,-]{0,40}(?:sentence|description|summary|explanation|line|paragraph|overview)\b.{0,80}|(?:please )?(?:describe|tell us|enter|insert|fill in|summari[sz]e) (?:the|your|what|how|any|here|in|this|which)\b.{0,60}(?:\(todo\)|\.{3}|…)?|(?:please )?(?:describe|explain|list|provide|add|write|attach|link) (?:the|your|what|how|any|a|an|all|here|steps|more|this|which)\b.{0,60}(?:\(todo\)|\.{3}|…)|(?:first|second|next|another|last) (?:change|item|entry|point|fix|feature|bullet)(?: \(todo\)|\W{0,4})|if applicable,? .{0,80}|steps? (?:to follow|go here|here)\W*|.{0,60}\(todo\)|todo(?::.{0,60})?|tbd|fixme.{0,40}|(?:first|second|third)? ?step\W*",
        )
    ),
    re.S,
)
_HEADING = re.compile(r"(?:#{1,6} .{1,60}|[^.!?。]{1,40}\??)")
#: Words of filler that nobody reads.
_FILLER = frozenset(
    "foo bar baz qux quux corge grault garply test testing blah bla xxx xxxx asdf asdfgh qwer qwerty jkl hjkl zxcv uiop yxcv abc 123 1234 lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    " porta erat tellus sapien nibh luctus orci dictum cursus mauris vivamus fringilla vestibulum pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas proin sollicitudin bibendum viverra lacinia congue risus ornare augue ligula pulvinar faucibus semper pretium hendrerit lectus suspendisse potenti aenean nullam donec quisque praesent maecenas phasellus etiam integer curabitur".split()
)
#: Small words without which no prose gets along; Latin filler has none of them.
_SMALL = frozenset("the of is are was were to and with for that this it be by from at on as not der die das und ist mit von den le les des du est une un dans el los las del es una con por que y de la".split())
_PUNCT = " \t.,;:!?…*_#>=-—–·•|~\"'()"


def _bars(line: str) -> bool:
    """Whether a line is 2 to 13 pieces of up to 40 characters with bars or dots between; a pattern for it would take
    exponential time on long table lines."""
    n = len(line)
    at = [i for i, c in enumerate(line) if c in "|·•›»"] if n <= 40 + 12 * 43 else []
    ends = (1 << 41) - 2  # bit i: a piece may end before place i
    for _ in range(12 if at else 0):
        starts = 0
        for i in at:
            if ends >> i & 1 or i and line[i - 1] == " " and ends >> i - 1 & 1:
                starts |= 1 << i + 1 | (1 << i + 2 if line[i + 1 : i + 2] == " " else 0)
        ends = 0
        for k in range(1, 41):
            ends |= starts << k
        if ends >> n & 1:
            return True
    return False


def marks_and_notices(text: str | None) -> tuple[bool, bool]:
    """(slot, notices) of a text: whether it has a mark of a known template language outside code; whether it says
    nothing but notices, errors, filler and unfilled fields, headers, footers and short headings aside."""
    if not text:
        return False, False
    text = UNSEEN.sub("", unicodedata.normalize("NFC", text))
    if not text.strip():
        return False, False
    prose = TICKS.sub("\x02", FENCE.sub("\n", text))
    lines = (" ".join(x.split()) for x in prose.split("\n")) if _SLOT_SIGN.search(prose) or "<" in prose else ()
    joined = "\n".join(x for x in lines if x and not is_code(spaced(x).strip() or x))
    low = joined.lower()
    slot = (
        "&" in text and _unknown_entity(TICKS.sub(" ", FENCE.sub("\n", text)))
        or bool(_SLOT_SIGN.search(joined) and _SLOT.search(joined))
        or "<" in joined and any(not closed_or_known(t, low) for t in TAG_SLOT.findall(low))
    )
    return bool(slot), not slot and _only_notices(text)


def _unknown_entity(text: str) -> bool:
    known = html.entities.html5
    return any(m not in known and f"{m};" not in known and f"{m.lower()};" not in known for m in _ENTITY_SLOT.findall(text))


def _only_notices(text: str) -> bool:
    notices = len(_COMMENT.findall(text)) if "<!--" in text else 0
    for raw in _COMMENT.sub(" ", FENCE.sub("\n\x03\n", text)).split("\n"):
        line = " ".join(html.unescape(_HTML.sub(" ", raw) if "<" in raw else raw).split())
        if not line:
            continue
        bare = line.lower()
        if _EDGE.match(bare) or _bars(bare):
            continue
        if "\x03" in line or "`" in line:
            return False
        words = re.findall(r"\w+", bare)
        if _is_filler(words) or bare[0] in "{[<(" and _ANCHORS.fullmatch(bare) or _TRACE.match(bare) and _ANCHORS.fullmatch(bare):
            notices += 1
            continue
        for sentence in SENTENCE.split(bare):
            s = sentence.strip(_PUNCT)
            if not s:
                notices += sentence.strip() in ("1.", "2.", "3.", "4.", "5.", "-", "*")
            elif not _QUOTED.search(sentence) and (_ANCHORS.fullmatch(sentence.strip()) or _ANCHORS.fullmatch(s)):
                notices += 1
            elif not (len(words) <= 5 and _HEADING.fullmatch(bare)):
                return False
    return notices > 0


def _is_filler(words: list[str]) -> bool:
    """Words of keyboard or Latin filler: most of them known, or a good part and no small word of a living language."""
    known = sum(w in _FILLER for w in words)
    return len(words) >= 3 and known >= 0.7 * len(words) or len(words) >= 5 and known >= 0.2 * len(words) and all(w.isalpha() and w not in _SMALL for w in words)


_TRACE = re.compile(r"file \"|\w*(?:error|exception)(?:: |$)|return |raise |traceback")
