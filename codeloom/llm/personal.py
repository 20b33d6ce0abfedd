"""Personal information in free text.

Method: weak supervision. Labelers vote on candidate spans: the format of the span, words
round it, a gazetteer, and words that speak against it. Expectation maximisation over the
counts of all vote patterns of all documents estimates how reliable each labeler is and how
likely each pattern marks a true item; spans with these probabilities, a bounded sample of
them, train a final logistic classifier on the span's shape and neighbours; its verdict is
combined with the pattern's. The counts have a fixed number of rows (types times patterns).

The gazetteer of names comes from the corpus: given and family names that stand in contexts
that only people stand in. It is joined by name, not broadcast.

Defined results: null, empty and blank texts give no item and come out unchanged; equal items
of one document give one row; where spans overlap, the longer wins, then email, id_number,
phone, address, name in this order; placeholders are [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS],
[NAME]. Whole texts are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.text import map_rows
from codeloom.plans.scratch import Scratch
from codeloom.sources.tables import table

TYPES = ("email", "id_number", "phone", "address", "name")
TRAINING_ROWS = 20_000
FEATURES = 4096

# Formats
_LOCAL = r"[^\W_](?:[\w.%+'-]*[^\W]|)"
_AT = r"(?:@|\s?[\[({<]\s?(?:at|AT|ät)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]+(?:\s(?:dot|DOT)\s|\.)))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+%/-])[A-Za-z0-9À-ɏ_](?:[\w.%+'-]*[\w])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*)(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-]|@)")
ID = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{1,2}\d{7,9}|\d{4}-\d{2}-\d{4}-[A-Z])(?![\w-]|\.\d)")
PHONE = re.compile(
    r"(?<![\w.+/-])(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ ./-]\d{2,6}){1,5}|\+\d{9,15}|00\d{1,3}[ .-]\d{1,5}(?:[ .-]\d{2,6}){1,5}|\(\d{2,5}\) ?\d{3,6}(?:[ .-]\d{2,6}){0,3}|(?:1[-. ])?\d{3}[-.]\d{3}[-.]\d{4}|(?:1 )?\d{3} \d{3} \d{4}|0\d{1,4}[ /.-]\d{2,8}(?:[ .-]\d{2,6}){0,4}|\d{3} \d{2} \d{2} \d{2}|\d{3} \d{3} \d{3}|\d{3} \d{6})(?![\w]|[-.]\d)"
)
_TYPE_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Close|Court|Ct|Way|Terrace|Crescent|Boulevard|Blvd|Avenue|Ave|Drive|Dr|Place|Pl|Square|Sq|Row|Hill|Parkway|Pkwy|Highway|Hwy|Circle|Cir|Trail|Grove|Gardens|Mews|Walk|Alley|Quay)"
_W = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_TYPE_FR = r"(?:rue|r\.|avenue|av\.|ave\.|boulevard|bd\.?|boul\.|chemin|ch\.|place|pl\.|quai|impasse|imp\.|allée|all\.|route|rte|cours|square|sentier|passage|faubourg|fg|voie|villa|cité|ruelle|montée|promenade|esplanade)"
#: Formats of addresses: words of which one must stand in the line, and the pattern.
ADDRESSES = [
    ([f" {w}" for w in _TYPE_EN[3:-1].split("|")], re.compile(
        rf"(?<![\w.])\d{{1,5}}(?:[a-z]|[ ]?[A-Z]|[ -](?:bis|ter|quater))?(?: (?:[NSEW]\.|[NS][EW]|North|South|East|West|Upper|Lower|Old|New))?(?: {_W}){{1,4}}? {_TYPE_EN}\b\.?"
    )),
    ([f" {w}" for w in _TYPE_FR[3:-1].replace(r"\.?", "").replace("\\", "").split("|")], re.compile(
        rf"(?<![\w.])\d{{1,5}}(?: ?(?:bis|ter|quater|[a-d](?![\w])))?,? {_TYPE_FR}(?:(?<=\.)|(?!\w))(?: (?:de la|de l['’]|des|du|de|d['’]|la|le|les|l['’]|sous|sur|aux?|à|en))*[ ]?{_W}(?:[ -](?:(?:de|des|du|la|le|les|et|sur|sous|aux?|d['’]|l['’])[ -]?)*{_W})*"
    )),
    ([*(f"{w} " for w in "straße strasse str. gasse weg allee platz ufer damm ring steig chaussee pfad graben markt hof berg tor turm brücke zeile stieg wall Straße Strasse Str. Gasse Weg Allee Platz Ufer Damm Ring Steig Markt Hof Am Im Zum Zur Beim".split()), "An de", "Auf de", "In de", "Unter den ", "Hinter de", "Vor dem ", "Alte", "Neue", "Große", "Kleine"], re.compile(
        rf"(?<![\w.])(?:(?:{_W} ){{0,2}}{_W}(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig|chaussee|pfad|graben|markt|hof|berg|tor|turm|brücke|zeile|stieg|wall)|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Hinter dem|Beim|Vor dem|Alte[rsn]?|Neue[rsn]?|Große[rsn]?|Kleine[rsn]?) (?:{_W} )?{_W}|{_W}(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring)|(?:{_W} )?{_W}[- ](?:Straße|Strasse|Str\.|Gasse|Weg|Allee|Platz|Ufer|Damm|Ring|Steig|Markt|Hof)) \d{{1,5}}(?: ?[a-z](?![\w]))?"
    )),
    ("Calle C/ C. Cl. Avenida Avda Av. Paseo P.º Pº Plaza Pl. Pza. Camino Cno. Cam. Carretera Ctra. Ronda Rda. Travesía Trav. Callejón Glorieta Gta. Vía Cuesta Rambla".split(), re.compile(
        rf"(?<![\w.])(?:Calle|C/|C\.|Cl\.|Avenida|Avda\.?|Av\.|Paseo|P\.º|Pº|Plaza|Pl\.|Pza\.|Camino|Cno\.|Cam\.|Carretera|Ctra\.|Ronda|Rda\.|Travesía|Trav\.|Callejón|Glorieta|Gta\.|Vía|Cuesta|Rambla) ?(?:(?:de la|de los|de las|del|de|la|el|los|las) )*{_W}(?: (?:(?:de la|de los|de las|del|de|la|el|y) )*{_W})*,? (?:n\.?º ?|núm\. )?\d{{1,5}}(?: ?(?:bis|ter|[A-Za-z](?![\w])))?"
    )),
    (["号"], re.compile(r"(?<=[到：:，,在于住址\s])[一-鿿]{2,6}?(?:路|街|巷|里|道|弄|胡同|大街)\d{1,5}号")),
]
_LETTERS = r"[^\W\d_]"
_GIVEN = rf"(?:{_LETTERS}\.(?:[ -]?{_LETTERS}\.)*|{_LETTERS}[\w'’]*(?:-{_LETTERS}[\w'’]*)?)"
_FAMILY = rf"{_LETTERS}[\w'’]+(?:-{_LETTERS}[\w'’]+)*"
_PARTICLE = r"(?:(?:van der|van den|van de|van|von der|von und zu|von|zu|de la|de los|del|de|da|dos|das|di|du|le|la|el|bin|ibn|ter|ten|af|Van Der|Van|Von|De|VAN DER|VAN|VON|DE) )"
_PERSON = rf"(?:{_PARTICLE}?{_FAMILY}, {_GIVEN}(?: {_LETTERS}\.)?|{_GIVEN}(?: {_LETTERS}\.| {_GIVEN})?? {_PARTICLE}?{_FAMILY}|{_GIVEN} {_LETTERS}\. {_PARTICLE}?{_FAMILY})"
_CJK = r"[一-鿿]{2,4}"
# Contexts in which people stand: words of which one must stand in the line, what comes before, what must follow. Fixed values.
_END = r"(?=[.,;](?:\s|$)|$|\n)"
_ROLES = "Author Authors Committer Assignee Owner Maintainer Reporter Autor Auteur Verfasser".split()
_FIELDS = "user name author fullname full_name owner contact customer employee".split()
_RECORD = "user customer contact patient employee account member client User Customer Contact Patient Employee Account Member Client".split()
#: Documents and numbers that belong to a person, by language: (words, words between them and the person).
_DOCUMENTS = [
    ("passport Passport licence license Licence License SSN ssn number Number No. no. ID id", "for|of|belonging to|issued to|held by"),
    ("DNI NIE NIF pasaporte Pasaporte", "de|a nombre de"),
    ("nummer ausweis Ausweis Reisepass", "von|für"),
    ("identité passeport Passeport", "de|pour"),
]
_COMPOUND = r"\w*"
_BY = [
    ("by ", r"[Rr]eviewed|[Rr]eported|[Ww]ritten|[Aa]pproved|[Ff]iled|[Mm]erged|[Ss]igned|[Ff]ixed|[Oo]pened|[Cc]losed|[Tt]ested|[Aa]uthored", "by", "and|&"),
    ("von ", r"[Gg]emeldet|[Gg]eprüft|[Gg]eschrieben|[Ee]rstellt|[Gg]enehmigt", "von", "und"),
    ("por ", r"[Ii]nformado|[Rr]evisado|[Rr]eportado|[Ee]scrito|[Aa]probado", "por", "y"),
    ("par ", r"[Ss]ignalé|[Rr]elu|[Éé]crit|[Rr]apporté|[Aa]pprouvé", "par", "et"),
]
CONTEXTS = [
    (["-by:", "-by :", *(f"{r}:" for r in _ROLES), *(f"{r} :" for r in _ROLES), "Assigned to"], rf"(?:\w+-by|{'|'.join(_ROLES)}|Assigned to)\s*:\s*(?P<n>{_PERSON})\s*(?=<|$|\n|[,;(]|\.(?:\s|$))"),
    *(([k], rf"(?<![\w-])(?:{verbs}) {by} (?P<n>{_PERSON})(?= (?:{also}) |[ ]?\(|[.,;](?:\s|$)|$|\n| on | in )") for k, verbs, by, also in _BY),
    *(([k], rf"(?<![\w-])(?:{verbs}) {by} {_PERSON} (?:{also}) (?P<n>{_PERSON}){_END}") for k, verbs, by, also in _BY),
    (["cc", "CC", "Cc", "cC"], rf"(?<![\w-])[Cc][Cc]:? (?P<n>{_PERSON}){_END}"),
    (["hanks to "], rf"(?<!\w)[Tt]hanks to (?P<n>{_PERSON})(?= for |[.,;!](?:\s|$)|$|\n)"),
    (["aired with "], rf"(?<!\w)[Pp]aired with (?P<n>{_PERSON})(?= on |[.,;](?:\s|$)|$|\n)"),
    (["TODO(", "FIXME(", "XXX(", "NOTE("], rf"(?<!\w)(?:TODO|FIXME|XXX|NOTE)\((?P<n>{_PERSON})\)"),
    (["reach ", "contact ", "call ", "Call ", "Contact ", "Reach "], rf"(?<!\w)(?:reach|contact|call|Reach|Contact|Call) (?P<n>{_PERSON}) (?:at|on|under|via) "),
    ([f"{r} {x}" for r in _RECORD for x in ("record", "profile", "entry")], rf"(?<!\w)(?:{'|'.join(_RECORD)}) (?:record|profile|entry)\s*[:=]\s*(?P<n>{_PERSON})(?=\s*[|,;/]|$|\n)"),
    ([f'{f}"' for f in _FIELDS], rf"\"(?:{'|'.join(_FIELDS)})\"\s*:\s*\"(?P<n>{_PERSON}|{_CJK})\""),
    *((words.split(), rf"(?<!\w){_COMPOUND if 'nummer' in words else ''}(?:{'|'.join(w.replace('.', '[.]') for w in words.split())})(?!\w)[^\n\d]{{0,16}}\d[\w -]{{3,20}}[^\n]{{0,50}}? (?:{of}) (?P<n>{_PERSON}){_END}") for words, of in _DOCUMENTS),
    (["hip ", "end ", "eliver ", "ost ", "orward "], rf"(?<!\w)(?:[Ss]hip|[Ss]end|[Dd]eliver|[Pp]ost|[Ff]orward) (?:the |a |it )?[\w ]{{0,24}}?\bto (?P<n>{_PERSON}), (?=\d|\w)"),
    (["an "], rf"(?<!\w)an (?P<n>{_PERSON}), (?=[^\n]{{0,60}}\d[^\n]{{0,60}}(?:schick|send|liefer))|(?<!\w)(?:[Ss]chick|[Ss]end|[Ll]iefer)\w*\b[\w ]{{0,24}}? an (?P<m>{_PERSON}), (?=[^\n]{{0,60}}\d)"),
    (["ragen an ", "Sie sich an "], rf"(?<!\w)(?:Rückfragen|Fragen|Wenden Sie sich) an (?P<n>{_PERSON})(?=, Tel|[.,;](?:\s|$)|$|\n)"),
    (["nviar", "nvíe", "andar"], rf"(?<!\w)(?:[Ee]nviar|[Ee]nvíe|[Mm]andar) [\w ]{{0,24}}?\ba (?P<n>{_PERSON}), "),
    (["nvoye", "xpédi"], rf"(?<!\w)(?:[Ee]nvoyer|[Ee]nvoyez|[Ee]xpédiez|[Ee]xpédier) [\w ]{{0,24}}?\bà (?P<n>{_PERSON}), "),
    (["lamar a", "lame a", "lamad a"], rf"(?<!\w)(?:[Ll]lamar|[Ll]lame|[Ll]lamad) a (?P<n>{_PERSON}) al "),
    (["oindre", "ppele", "ontacte", "oignez"], rf"(?<!\w)(?:[Jj]oindre|[Aa]ppelez|[Aa]ppeler|[Cc]ontacter|[Cc]ontactez|[Jj]oignez) (?P<n>{_PERSON}) au "),
    (["联系"], rf"联系(?P<n>{_CJK}?)(?=[。，；！？\s]|$)"),
    (["由"], rf"由(?P<n>{_CJK}?)(?=报告|提交|审核|编写|修复|负责)"),
    ("感谢 作者 收件人 联系人 审核人 负责人 姓名".split(), rf"(?:感谢|作者[：:]\s*|收件人[：:]\s*|联系人[：:]\s*|审核人[：:]\s*|负责人[：:]\s*|姓名[：:]\s*)(?P<n>{_CJK}?)(?=[的。，；！？\s]|$)"),
]
_GREETINGS = "Regards|Best|Cheers|Thanks|Sincerely|Best regards|Kind regards|Viele Grüße|Mit freundlichen Grüßen|Grüße|Gruß|Cordialement|Bien à vous|Saludos|Un saludo|Atentamente|此致|谢谢"
SIGNATURE = re.compile(rf"(?<!\w)(?:{_GREETINGS})[,，!.]?[ \t]*\r?\n[ \t]*(?P<n>{_PERSON})[ \t]*(?=\r?\n|$)")
_NAMES = [re.compile(pattern) for _, pattern in CONTEXTS]
_SIGNED = re.compile(rf"(?:{_GREETINGS})[,，!.]?[ \t]*\r?\n")
_AT_WORDS = ["at]", "at)", "at}", "at>", "AT]", "AT)", "AT}", "AT>", "ät]", "ät)", "ät}", "ät>", "at ]", "at )", "at }", "at >", "AT ]", "AT )", "AT }", "AT >", "ät ]", "ät )", "ät }", "ät >", " AT ", " at ", "\tat ", "@"]
_DISGUISE = re.compile(r"[\[({<]\s?(?:at|AT|ät)\s?[\])}>]| AT |\sat\s[\w-]+(?:\s(?:dot|DOT)\s|\.\w)")
_STAMP = re.compile(r"\d{4}-\d\d-\d\dT")
_NUMBERS = re.compile(r"\d[\d .()/-]{4,}\d")
_CAPITAL = r"[A-ZÀ-ÖØ-Þ]"
WEAK_NAME = re.compile(rf"(?<![\w./@-]){_CAPITAL}[a-zß-ÿ'’]{{1,20}} (?:{_CAPITAL}\. |van der |van |von |de la |del |de )?{_CAPITAL}[a-zß-ÿ'’]{{2,24}}(?:-{_CAPITAL}[a-zß-ÿ'’]{{2,24}})?(?![\w/@-])")
# Words before or after a span that speak for or against each type. Fixed values.
FOR = {
    "email": re.compile(r"mail|kontakt|contact|correo|邮箱|ping|by|von|por|par|<$|\($", re.I),
    "phone": re.compile(r"tel|phone|call|reach|au$|al$|电话|请致电|mobile|fax|\|\s*$|联系|an$|at$|handy|móvil|portable", re.I),
    "id_number": re.compile(r"ssn|passport|\bid\b|\bno\.|dni|nie|ausweis|identit|tax|证件|national|\|\s*$|printed|insurance|licen[cs]e", re.I),
    "address": re.compile(r"office|addr|ship|send|schicken|gerät|placa|carte|\|\s*$|address|anschrift|domicil|direcci|wohn|lives|to [\w. -]+,\s*$|[àaan]+ [\w. -]+,\s*$", re.I),
    "name": re.compile(r".", re.S),
}
AGAINST = {
    "email": re.compile(r"(?:\bssh|\bscp|\brsync|\bsftp|\bclone|\bgit|://[^\s]*|\bpinned|\binstall|\bnpm|\bfetch|\bremote|\blogin)\s*(?:-\w+ \S+ )*$", re.I),
    "phone": re.compile(r"(?:\bversions?|\bbuild|\brange|\bstamps?|\brev(?:ision)?|\bports?|\bip|\btrace|\bspan|\brequest|\bcommit|\brelease|\bv|#|=|\bid|\bjob|\bticket|\bissue|\bpid|\boffset|\blines?|\brows?|\bsize|\bbytes?)[\s:#-]*$", re.I),
    "id_number": re.compile(r"(?:\btrace|\bspan|\brequest|\bcommit|\bbuild|\bversions?|\bhash|\bsha\d*|\bdigest|\bticket|\bissue|\bjob|\bsession|\brange|\bstamps?|\brelease|\bbatch|\bpart|\bmodel|\border)(?: ?id)?[\s:#=-]*$", re.I),
    "address": re.compile(r"(?:\bsections?|\bchapters?|\bfigures?|\btables?|\bsteps?|\bversions?|\bpages?|\band|\bin|\bsplit|\bof|\bitems?|\bparts?|\bphases?|\blevels?|\blines?)[\s:#]*$", re.I),
    "name": re.compile(r"(?!)"),
}
TRAP_AFTER = {
    "email": re.compile(r":[\w/~]|/\w"),
    "phone": re.compile(r"\s?(?:ms|MB|GB|KB|kB|s\b|%|bytes|rows|files|lines|passed)"),
    "id_number": re.compile(r"(?!)"),
    "address": re.compile(r"\s(?:tiles?|Network|Detection|Map|of the plan|Module|Graph|Layer|Test|Service|Index|Protocol|View)\b|[A-Za-z]"),
    "name": re.compile(r"(?!)"),
}


def _ok(kind: str, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    if kind == "phone":
        return 8 <= digits <= 15 and not re.fullmatch(r"\d{4}[-/. ]\d{2}[-/. ]\d{2}.*", value)
    return True


@lru_cache(1)
def _keys() -> ahocorasick.Automaton:
    """One pass over a text tells which patterns to try: -1 emails, from 0 on addresses, then the contexts of names."""
    groups: dict[str, set[int]] = {}
    for group, words in [(-1, _AT_WORDS), *enumerate([w for w, _ in ADDRESSES] + [w for w, _ in CONTEXTS])]:
        for word in words:
            groups.setdefault(word, set()).add(group)
    out = ahocorasick.Automaton()
    for word, tried in groups.items():
        out.add_word(word, tuple(tried))
    out.make_automaton()
    return out


def candidates(text: str, weak: bool) -> list[tuple[int, int, str, int]]:
    """(start, end, type, votes) of all candidate spans. Votes: two bits each (1 for, 2 against) of
    format, context, gazetteer and counter-context; the gazetteer's are set later."""
    starts, lines = [0], text.split("\n")
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    tries: set[tuple[int, int]] = set()
    at, stop = 0, starts[1]
    for end, groups in _keys().iter(text):
        if end >= stop:
            at = bisect_right(starts, end, at) - 1
            stop = starts[at + 1]
        for group in groups:
            tries.add((at, group))
    found: list[tuple[str, int, int]] = []
    out: list[tuple[int, int, str, int]] = []
    for at, group in sorted(tries):
        line, offset = lines[at].rstrip("\r"), starts[at]
        if group >= len(ADDRESSES):
            _named(_NAMES[group - len(ADDRESSES)], line, offset, out)
        elif group >= 0:
            found += [("address", offset + m.start(), offset + m.end()) for m in ADDRESSES[group][1].finditer(line)]
        elif "@" in line or _DISGUISE.search(line):
            found += [("email", offset + m.start(), offset + m.end()) for m in EMAIL.finditer(line)]
    numbered, at = -1, 0
    for m in _NUMBERS.finditer(text):
        at = bisect_right(starts, m.start(), at) - 1
        offset = starts[at]
        if at == numbered or (m.end() - offset <= 20 and _STAMP.match(text, offset)):
            continue
        numbered, line = at, lines[at].rstrip("\r")
        found += [("id_number", offset + x.start(), offset + x.end()) for x in ID.finditer(line)]
        found += [("phone", offset + x.start(), offset + x.end()) for x in PHONE.finditer(line) if _ok("phone", x.group())]
    for kind, start, end in found:
        before, after = text[max(0, start - 40) : start].rsplit("\n", 1)[-1], text[end : end + 24]
        votes = 1 | (4 if FOR[kind].search(before[-28:] + "\x01" + after[:12]) else 0) | (128 if AGAINST[kind].search(before) or TRAP_AFTER[kind].match(after) else 0)
        out.append((start, end, kind, votes))
    if _SIGNED.search(text):
        _named(SIGNATURE, text, 0, out)
    if weak:
        taken = sorted((s, e) for s, e, _, _ in out)
        k, reach = 0, 0
        for m in WEAK_NAME.finditer(text):
            while k < len(taken) and taken[k][0] < m.end():
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= m.start():
                out.append((*m.span(), "name", 1))
    return out


def _named(pattern: re.Pattern, text: str, at: int, out: list) -> None:
    for m in pattern.finditer(text):
        group = "n" if m.group("n") else "m"
        start, end = m.span(group)
        if not _not_person(m.group(group)):
            out.append((at + start, at + end, "name", 4 | (1 if _shape_of_name(m.group(group)) else 0)))


_STOP = frozenset("the a an this that these those we you they it he she i and or but for with from in on at to of by as is are was were be been if when while because who all each every team bot core platform build release main master branch kernel index graph report summary".split())


def _not_person(value: str) -> bool:
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", value)]
    return not words or any(w in _STOP and len(w) > 1 for w in words) or any(c.isdigit() or c == "_" for c in value)


def _shape_of_name(value: str) -> bool:
    words = [w for w in re.findall(r"[^\W\d_]+", value)]
    return all(w[0].isupper() or len(w) <= 4 for w in words) or value.islower() or "一" <= value[0] <= "鿿"


def shape_features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Hashed features of a span: its shape and the words next to it."""
    value = text[start:end]
    shape = re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"\d", "0", value)))[:40]
    before = re.findall(r"\w+|[^\w\s]", text[max(0, start - 40) : start])[-3:]
    after = re.findall(r"\w+|[^\w\s]", text[end : end + 30])[:2]
    names = [f"k={kind}", f"s={shape}", f"n={min(end - start, 40) // 4}", *(f"b{i}={re.sub(r'[0-9]', '0', w.lower())}" for i, w in enumerate(reversed(before))), *(f"a{i}={re.sub(r'[0-9]', '0', w.lower())}" for i, w in enumerate(after))]
    return [_hash(f"{kind}|{n}") for n in names]


def _hash(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()) % FEATURES


_SPAN = "doc_id long, start int, stop int, pii_type string, votes int, pii_value string, features array<int>"
_SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("pii_type", pa.string()), ("votes", pa.int32()), ("pii_value", pa.string()), ("features", pa.list_(pa.int32()))])


def _spans(doc_id: int, text: str | None) -> Iterator[tuple]:
    if text:
        for start, end, kind, votes in candidates(text, weak=True):
            yield doc_id, start, end, kind, votes, text[start:end], shape_features(text, start, end, kind)


def with_gazetteer(spans: DataFrame) -> DataFrame:
    """Sets the gazetteer's vote: do the given and the family name, or the domain of an address, stand in such contexts elsewhere?"""
    lower = F.lower("pii_value")
    parts = F.filter(F.split(F.regexp_replace(lower, r"[,.]", " "), r"\s+"), lambda w: F.length(w) > 2)
    domain = F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, r"^.*?(?:@|[\[({<]\s?(?:at|ät)\s?[\])}>]|\sat\s)\s?", ""), r"\s?[\[({<]\s?(?:dot|punkt|point|punto)\s?[\])}>]\s?|\sdot\s", "."), r"^.*\.(?=[^.]+\.[^.]+$)", "")
    words = F.when(F.col("pii_type") == "name", F.array_distinct(parts)).otherwise(F.array(domain))
    named = spans.where("pii_type in ('name', 'email')").withColumn("word", F.explode(words))
    known = named.where("(votes & 4) = 4").groupBy("pii_type", "word").agg(F.countDistinct("doc_id").alias("n")).where("n >= 3").select("pii_type", "word")
    hits = named.join(known, ["pii_type", "word"], "left_semi").groupBy("doc_id", "start", "stop", "pii_type").agg(F.countDistinct("word").alias("hits"))
    joined = spans.join(hits, ["doc_id", "start", "stop", "pii_type"], "left")
    enough = F.col("hits") >= F.when(F.col("pii_type") == "name", 2).otherwise(1)
    unknown = (F.col("pii_type") == "name") & F.col("hits").isNull() & F.col("pii_value").rlike("[A-Za-z]{3}")
    return joined.withColumn("votes", F.when(enough, F.col("votes").bitwiseOR(16)).when(unknown, F.col("votes").bitwiseOR(32)).otherwise(F.col("votes"))).drop("hits")


LABELERS = ((1, 2), (4, 8), (16, 32), (64, 128))
#: Prior log odds, beside the labelers' votes, of a strict format or a person's context that nothing speaks against;
#: taken off a counter-context without a context, and a bare guess of a name. Votes and classifier can overturn it;
#: it matters in small corpora, whose votes say little (without it, the large check tables give the same items).
LEANING = 0.5
#: Starting points of the estimation: (chance to vote for, chance to vote against) a true item, and a false one.
PRIOR = (((0.95, 0.01), (0.6, 0.3)), ((0.8, 0.05), (0.2, 0.2)), ((0.5, 0.1), (0.05, 0.5)), ((0.01, 0.02), (0.01, 0.5)))


def leaning(kind: str, votes: int) -> float:
    """The prior log odds of a pattern."""
    if (votes & 128 and not votes & 4) or (kind == "name" and not votes & 4 and not votes & 16):
        return -LEANING
    return LEANING if votes & (4 if kind == "name" else 1) and not votes & 128 else 0.0


#: Starting shares of true items among candidates, 0.7 where not named: any two capitalised words make a candidate of a name.
SHARES = {"name": 0.3}
#: Weight of the starting points against the votes of the corpus.
ANCHOR = 0.1


def estimate(counts: dict[tuple[str, int], int], rounds: int = 30) -> dict[tuple[str, int], float]:
    """The probability that a span of each (type, votes) is a true item, by expectation maximisation."""
    result = {}
    for kind in {k for k, _ in counts}:
        patterns = [v for k, v in counts if k == kind]
        n = np.array([counts[kind, v] for v in patterns], float)
        lean = np.array([leaning(kind, v) for v in patterns])
        votes = np.array([[0 if v & a else 1 if v & b else 2 for a, b in LABELERS] for v in patterns])
        share = SHARES.get(kind, 0.7)
        rates = np.array([[[t[0], t[1], 1 - sum(t)] for t in p] for p in PRIOR])  # labeler, true/false, vote
        anchor = (20.0 + ANCHOR * n.sum()) * rates
        for _ in range(rounds):
            logs = np.log(rates)
            true = np.log(share) + sum(logs[j, 0, votes[:, j]] for j in range(len(LABELERS)))
            false = np.log(1 - share) + sum(logs[j, 1, votes[:, j]] for j in range(len(LABELERS)))
            p = 1 / (1 + np.exp(np.clip(false - true - lean, -50, 50)))
            share = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
            for j in range(len(LABELERS)):
                for v in range(3):
                    rates[j, 0, v] = anchor[j, 0, v] + (n * p)[votes[:, j] == v].sum()
                    rates[j, 1, v] = anchor[j, 1, v] + (n * (1 - p))[votes[:, j] == v].sum()
                rates[j] /= rates[j].sum(axis=1, keepdims=True)
        result |= {(kind, v): float(x) for v, x in zip(patterns, p)}
    return result


#: Training rows at which the classifier has half of its full weight.
HALF_TRAINED = 500


def train(features: list[list[int]], target: list[float], rounds: int = 60) -> np.ndarray:
    """Logistic regression on hashed features with soft targets; the last weight is the bias. Few rows give small weights."""
    weights = np.zeros(FEATURES + 1)
    if not features:
        return weights
    sizes = np.array([len(f) for f in features])
    rows, cols = np.repeat(np.arange(len(features)), sizes), np.concatenate([np.asarray(f, int) for f in features])
    y, squares = np.asarray(target), np.full(FEATURES + 1, 1e-6)
    for _ in range(rounds):
        z = np.bincount(rows, weights[cols], len(y)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        step = np.append(np.bincount(cols, error[rows], FEATURES), error.sum()) + 1e-3 * weights
        squares += step**2
        weights -= 0.5 * step / np.sqrt(squares)
    return weights * (len(y) / (len(y) + HALF_TRAINED))


def verdict(chance: float, z: float) -> float:
    """The probability by the pattern's chance and the classifier's log odds, which weigh the same."""
    p = min(max(chance, 1e-4), 1 - 1e-4)
    limit = np.log((1 - 1e-4) / 1e-4)
    return float(1 / (1 + np.exp(-(np.log(p / (1 - p)) + np.clip(z, -limit, limit)) / 2)))


def personal_items(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, start, stop, pii_type, pii_value, probability of every accepted span, without overlaps."""
    spans = map_rows(documents.select("doc_id", "text").where("text is not null"), _spans, _SPAN, _SPAN_ARROW)
    spans = scratch.spool(with_gazetteer(scratch.spool(spans)))
    counts = {(r[0], r[1]): r[2] for r in spans.groupBy("pii_type", "votes").count().collect()}  # types times patterns
    chance = estimate(counts)
    total = sum(counts.values())
    sample = spans.select("pii_type", "votes", "features", F.xxhash64("doc_id", "start").alias("h")).where(F.pmod("h", F.lit(1_000_003)) < max(1, int(1_000_003 * min(1.0, TRAINING_ROWS / max(1, total))))).limit(2 * TRAINING_ROWS).collect()
    weights = train([r[2] for r in sample], [chance[r[0], r[1]] for r in sample])

    def score(doc_id, start, stop, kind, votes, value, features):
        z = float(weights[np.asarray(features, int)].sum() + weights[-1])
        yield doc_id, start, stop, kind, value, verdict(chance[kind, votes], z)

    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("pii_type", pa.string()), ("pii_value", pa.string()), ("probability", pa.float64())])
    scored = map_rows(spans.select("doc_id", "start", "stop", "pii_type", "votes", "pii_value", "features"), score, "doc_id long, start int, stop int, pii_type string, pii_value string, probability double", arrow)
    kept = scored.where("probability > 0.5").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "pii_type", "pii_value", "probability")).alias("spans"))

    def settle(doc_id, items):
        taken: list[tuple[int, int]] = []
        for s in sorted(items, key=lambda s: (s["start"] - s["stop"], TYPES.index(s["pii_type"]), s["start"])):
            if all(s["stop"] <= a or s["start"] >= b for a, b in taken):
                taken.append((s["start"], s["stop"]))
                yield doc_id, s["start"], s["stop"], s["pii_type"], s["pii_value"], s["probability"]

    return map_rows(kept, settle, "doc_id long, start int, stop int, pii_type string, pii_value string, probability double", arrow)


def redacted(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and text with typed placeholders, for every document."""
    items = personal_items(documents, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "pii_type")).alias("items"))

    def replace(doc_id, text, items):
        if text:
            for s in sorted(items or (), key=lambda s: -s["start"]):
                text = f"{text[: s['start']]}[{s['pii_type'].upper()}]{text[s['stop'] :]}"
        yield doc_id, text

    joined = documents.select("doc_id", "text").join(items, "doc_id", "left")
    return map_rows(joined, replace, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(table(spark, sf_dir, "documents"), Scratch(spark, "p8_found")).select("doc_id", "pii_type", "pii_value").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents"), Scratch(spark, "p8_redacted"))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE: dict[str, str] = {}
