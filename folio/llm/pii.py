"""Personal information in free text: find it by anchors, mask it by type.

One Aho-Corasick automaton holds every anchor: at-signs however written, titles, identifier
and street words, the digits, and the known names (with the names built from the lexicon's own
productive parts).  At each anchor a deterministic local parser expands to the item's borders and
checks its form: numbering plans for telephone numbers, check digits for identity and account
numbers.  A known name that the corpus writes in lower case more often than with a capital is an
ordinary word too, and a capital letter alone does not make it a name; this is counted over all
documents first.

Defined results: null or empty text holds nothing and comes back unchanged; each row is judged
for itself; an item wrapped over two lines counts on the line where it begins; labels and
titles are not part of an item; overlapping readings of one place give one item (the order of
``_RANK`` decides); texts of any length are read whole.  Account numbers (IBAN, payment card) are
masked and listed by ``scan``; ``found_lines`` reports the five personal types only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANK = {"email": 0, "account": 1, "id_number": 2, "address": 3, "phone": 4, "name": 5}
PERSONAL = ("email", "phone", "id_number", "address", "name")
# between the words of an item: blanks, or a line break with the next line's quote or comment mark
_GAP = r"(?:[ \t ]+|[ \t]*\r?\n[ \t]*(?:(?:[>#*|]|//|--)+[ \t]*)*)"
_UP = "A-ZÀ-ÖØ-ÞĀĆČĒĘŁŃŠŚŹŻŽ"
_LOW = "a-zß-öø-ÿāąćčēęłńšśźżž"
_WORD = rf"[{_UP}][{_UP}{_LOW}'’]+(?:-[{_UP}][{_UP}{_LOW}'’]+)*"
_PARTICLE = r"(?:(?:de|da|di|del|van|von|der|den|la|le|las|los|zu|DE|DA|DEL|VAN|VON|DER|DEN|LA|LE)" + _GAP + r"){0,3}"
_FAMILY = rf"{_PARTICLE}{_WORD}"

# ---- email ------------------------------------------------------------------------------
_AT = rf"(?:@|%40|&#0*64;|&#x40;|&commat;|\s*[(\[{{<]\s*(?:at|@|arobase|arroba)\s*[)\]}}>]\s*|{_GAP}(?:AT|at|ät){_GAP})"
_DOT = rf"(?:\.|\s*[(\[{{<]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}}>]\s*|{_GAP}(?:DOT|dot){_GAP})"
_EMAIL = re.compile(rf"(?<![\w.+%/-])(?P<local>[A-Za-z0-9_](?:[\w.+%'-]*[\w+-])?)(?P<at>{_AT})(?P<host>[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)", re.I)
_EMAIL_NOT_AFTER = re.compile(r":[\w~./-]|/[\w.-]+\.git")
_EMAIL_ROBOT = re.compile(r"(?i)^(?:git|svn|hg|ssh)$")
_PLAIN_AT = re.compile(rf"{_GAP}(?:AT|at|ät){_GAP}")

# ---- numbers ----------------------------------------------------------------------------
_SP = r"(?:[ .\-/ ‑]|[ \t]*\r?\n[ \t]*(?:(?:[>#*|]|//|--)+[ \t]*)*)"
_PHONES = (
    rf"(?:\+\d{{1,3}}|00[1-9]\d{{1,2}}(?={_SP})){_SP}?(?:\(0\){_SP}?)?(?:\(\d{{2,4}}\){_SP}?)?\d{{1,5}}(?:{_SP}?\d{{2,8}}){{1,5}}",
    rf"(?:1{_SP})?\(\d{{3}}\){_SP}?\d{{3}}{_SP}\d{{4}}",
    rf"1?{_SP}?[2-9]\d\d(?P<s>[.\-]|{_GAP})\d{{3}}(?P=s)\d{{4}}",
    r"[2-9]\d\d-\d{4}",
    rf"0\d(?:{_SP}\d\d){{4}}",
    rf"0\d{{2,4}}{_SP}\d{{3,8}}(?:{_SP}\d{{2,5}}){{0,2}}",
    rf"\(0\d{{2,4}}\){_SP}?\d{{3,8}}(?:{_SP}\d{{2,5}}){{0,2}}",
    r"[6789]\d\d-\d{3}-\d{3}",
    rf"[6789]\d\d(?:{_SP}\d\d){{3}}",
)
_PHONE = re.compile(rf"(?:{'|'.join(p.replace('P<s>', f'P<s{i}>').replace('P=s', f'P=s{i}') for i, p in enumerate(_PHONES))})(?:{_GAP}?(?:ext|x|poste|Durchwahl|DW)\.?{_GAP}?\d{{1,5}})?(?![\w-]|[.,/:]\d)")
_LOCAL = re.compile(r"(?P<exchange>[2-9]\d\d)-\d{4}")  # without its area code
_PHONE_CUE = re.compile(r"(?i)(?:phone|tel|téléphone|teléfono|call|ring|dial|fax|mobile|cell|handy|anruf|ruf|appel|móvil|text|sms|at|on|under|unter|al|au)\W{0,6}$")
# what other numbers are called; general vocabulary in the languages at hand
_PHONE_NOT_BEFORE = re.compile(
    r"(?i)(?:part|serial|model|item|article|artikel|ticket|build|bug|lines?|rows?|page|chapter|total|revision|rev|version|release|position|offset|address|checksum|hash|port|listening on|isbn|issn|doi|issue|order|bestellung|invoice|rechnung|facture|factura|receipt|batch|lot|commit|job|run|pid|id|range|figure|table|rfc|iso)"
    r"[ \t\r\n>*/#|]*(?:no\.?|nr\.?|n°|#|number)?[ \t\r\n>*/#|:]*$"
)
_IBAN = re.compile(r"[A-Z]{2}\d\d(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?:4\d{3}|5[1-5]\d\d|2[2-7]\d\d|6(?:011|5\d\d))(?P<g>[ -]?)\d{4}(?P=g)\d{4}(?P=g)\d{4}(?![\w-])|3[47]\d\d(?P<h>[ -]?)\d{6}(?P=h)\d{5}(?![\w-])")
_CARD_CUE = re.compile(r"(?i)card|visa|credit|debit|carte|karte|tarjeta|konto|account|cuenta|compte")
_IDS_PLAIN = re.compile(
    rf"(?:\d{{3}}-\d\d-\d{{4}}|[12]{_SP}\d\d{_SP}\d\d{_SP}\d[\dAB]{_SP}\d{{3}}{_SP}\d{{3}}(?:{_SP}\d\d)?|[12]\d{{2}}(?:0[1-9]|1[0-2]|[2-9]\d)\d[\dAB]\d{{6}}{_SP}?\d\d|[0-9]{{8}}-?(?P<check>[A-Z]))(?![\w-])"
)
#: Check letters of the Spanish identity number, by remainder of division by 23.
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_NI_PLAIN = re.compile(rf"(?<![\w-])[A-Z][A-Z]{_SP}?\d\d{_SP}\d\d{_SP}\d\d{_SP}?[A-D](?![\w-])")
_ID_CUES: tuple[tuple[str, str], ...] = (
    (r"(?:us )?ssn|(?:social )?security (?:no|number|nr)|social security|sozialversicherungs(?:nummer|-?nr)", rf"\d{{3}}{_SP}?\d\d{_SP}?\d{{4}}"),
    (r"ni number|nino|national insurance(?: (?:no|number))?", rf"[A-Z]{{2}}{_SP}?\d\d{_SP}?\d\d{_SP}?\d\d{_SP}?[A-D]"),
    (r"steuer-?id(?:entifikationsnummer)?|steuernummer|steuer-?nr|idnr|tax(?:payer)? (?:id|no|number)|tin", rf"\d\d{_SP}?\d{{3}}{_SP}?\d{{3}}{_SP}?\d{{3}}|\d{{2,3}}[-/ ]\d{{3,7}}(?:[/ -]\d{{3,5}})?"),
    (r"ausweis(?:-?nr|nummer)?|personalausweis(?:-?nr|nummer)?|identity card(?: (?:no|number))?|id card(?: (?:no|number))?|carte d[’']identité|cni", r"[A-Z0-9]{2,3}[A-Z0-9 ]{5,9}[A-Z0-9]"),
    (r"passport(?: (?:no|number|nr))?|passeport|pasaporte|reisepass(?:-?nr|nummer)?|pass-?nr", r"[A-Z]{1,2}\d{6,8}|[A-Z0-9]{8,9}(?<=\d)|\d{2}[A-Z]{2}\d{5}|\d{9}"),
    (r"nir|insee|n[°º] ?s[ée]cu|num[ée]ro de s[ée]curit[ée] sociale", rf"[12]{_SP}?\d\d{_SP}?\d\d{_SP}?\d[\dAB]{_SP}?\d{{3}}{_SP}?\d{{3}}(?:{_SP}?\d\d)?"),
    (r"dni|nif|nie|n\.i\.f\.|d\.n\.i\.", r"[XYZ]?-?\d{7,8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z]"),
)
_ID_VALUES = tuple((re.compile(rf"(?i:{cue})"), re.compile(value)) for cue, value in _ID_CUES)
_ID_JOIN = re.compile(rf"(?:[.:#,=\"'`)\]]|[ \t ]|\r?\n[ \t]*(?:(?:[>#*|]|//|--)+[ \t]*)*|(?i:no|nr|num|number|numéro|núm|n[°ºo])\b\.?){{0,6}}")
_ID_ANCHORS = ("ssn", "social security", "security no", "security number", "sozialversicherung", "ni number", "nino", "national insurance", "steuer", "idnr", "tax id", "tax no", "tax number", "taxpayer", "ausweis", "identity card", "id card", "carte d", "passport", "passeport", "pasaporte", "reisepass", "pass-nr", "nir", "insee", "sécu", "secu", "sécurité sociale", "dni", "nif", "nie", "tin", "cni")

# ---- address ----------------------------------------------------------------------------
_STREET_EN = r"(?i:street|avenue|road|lane|drive|close|court|crescent|terrace|square|boulevard|parade|gardens|mews|row|hill|way|place)|St\.?|Ave\.?|Rd\.?|Ln\.?|Blvd\.?|Dr\.?"
_CAPS = rf"[{_UP}][{_UP}{_LOW}'’-]*\.?"
_ADDRESSES = (
    re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,?{_GAP}(?:{_CAPS}{_GAP}){{1,3}}(?:{_STREET_EN})(?![\w])"),
    re.compile(rf"(?<![\w.-])\d{{1,4}}(?:{_GAP}?(?:bis|ter|quater))?[A-D]?,?{_GAP}(?i:rue|avenue|av\.|boulevard|bd\.?|place|chemin|impasse|allée|quai|cours|route|passage|square|sentier){_GAP}(?:(?:de|du|des|d['’]|la|le|les|l['’]|DE|DU|DES|LA|LE|LES)(?:{_GAP})?)*[{_UP}][\w'’-]*"),
    re.compile(rf"(?<![\w-])(?:(?:Am|An der|Auf dem|Im|In der|Zum|Zur|AM|IM){_GAP})?[{_UP}][{_UP}{_LOW}-]*(?:{_GAP}(?:Straße|Strasse|STRASSE|STRAßE|Weg|Platz|Allee|Ring|Gasse|Ufer|Damm|Stieg|Chaussee)|(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|stieg|chaussee|steig|markt|hof|graben|STRAßE|STRASSE|STR\.|WEG|GASSE|PLATZ)){_GAP}\d{{1,4}}{_GAP}?[a-z]?(?![\w.-]\d|\w)"),
    re.compile(rf"(?<![\w-])(?:Am|An der|Auf dem|Im|In der|Zum|Zur|AM){_GAP}[{_UP}][{_UP}{_LOW}-]+{_GAP}\d{{1,4}}[a-z]?(?=[,;]?{_GAP}?\d{{5}}\b)"),
    re.compile(rf"(?<![\w-])(?:(?i:calle|avda\.?|avenida|paseo|plaza|camino|ronda|travesía|carretera|pza\.?|glorieta)|C/|c/){_GAP}?(?:(?:de|del|la|las|los|el|DE|DEL|LA|LAS|LOS|EL){_GAP})*[{_UP}][\w'’-]*(?:{_GAP}(?:(?:de|del|la|las|los|el){_GAP})*[{_UP}][\w-]*){{0,3}},?{_GAP}(?:n\.?[º°o]?{_GAP}?)?\d{{1,4}}(?:{_GAP}?(?:bis|[A-D]))?(?!\w)"),
)
_ADDRESS_ANCHORS = {
    "address_en": tuple("street avenue road lane drive close court crescent terrace square boulevard parade gardens mews st. ave. rd. ln. blvd dr.".split()) + (" st", " ave", " rd", " ln", " hill", " way", " row", " place"),
    "address_fr": tuple("rue avenue av. boulevard bd place chemin impasse allée quai cours route passage square sentier".split()),
    "address_de": tuple("straße strasse str. weg gasse platz allee ring ufer damm stieg steig markt hof graben chaussee".split()),
    "address_am": ("am ", "zum ", "zur ", "an der ", "auf dem ", "im ", "in der ", "am\n", "zum\n"),
    "address_es": tuple("calle avda avenida paseo plaza camino ronda travesía carretera pza glorieta c/".split()),
}
_NUMBER_NEAR_LEFT = re.compile(r"\d[A-Da-z]?,?[ \t\r\n>#*|/\u00a0-]+(?:(?:bis|ter|quater)[ \t\r\n>#*|/-]+)?$")
_NUMBER_NEAR_RIGHT = re.compile(r"[ \t\r\n>#*|/\u00a0-]{1,12}\d")


# ---- names ------------------------------------------------------------------------------
_TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "mme", "mlle", "monsieur", "madame", "mademoiselle", "sr", "sra", "srta", "señor", "señora", "don", "doña", "sir", "herrn", "m.")
_TITLE_RX = re.compile(rf"(?<![\w@])(?:Mrs?|Ms|Miss|Drs?|Prof|Professor|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Mademoiselle|M|Sra?|Srta|Señora?|Don|Doña|Sir|MRS?|MS|DR|HERR|FRAU|MME)\b\.?{_GAP}")
_TITLE_BEFORE = re.compile(_TITLE_RX.pattern + "$")
_CUES = ("signed-off-by:", "co-developed-by:", "co-authored-by:", "reviewed-by:", "reported-by:", "tested-by:", "acked-by:", "suggested-by:", "assigned to:", "fn:", "author = {name = \"", "\"name\": \"", "contact ", "contact: ", "author: ", "authors: ", "maintainer: ", "reviewer: ", "approver: ", "kontakt: ", "contacto: ", "auteur: ", "auteur : ", "autor: ", "autorin: ", "ansprechpartner: ", "reported by: ", "requested by: ")
_SAID = ("wrote:", "writes:", "schrieb:", "écrit :", "écrit:", "escribió:", "said:", "wrote\n", "wrote ")
_ROLES = frozenset("team teams support group list department office desk service services sales security help info project core platform bot admin administrator owner owners maintainer maintainers developer developers engineering operations ops contributors authors community committee board staff us me them him her you everyone anyone".split())
_INITIAL = rf"[{_UP}]\."
_NOT_GIVEN = frozenset("the this that these each every only when after before between nobody please set use if we it its a an and or for from to by with in on at of dear hello hi thanks thank danke merci gracias hola bonjour guten tag contact author name see ask mail write reported signed reviewed assigned informado gemeldet signalé relu lo pidió die der das den dem ein eine falls ohne danach für jede voir aussi si le la les un une ce chaque el los las cada ningún upper lower north south east west new old saint san santa open big mr mrs ms miss dr prof professor herr herrn frau mme mlle monsieur madame mademoiselle sr sra srta señor señora don doña sir".split())
# what turns a name into a place, an organisation or a product; general designators
_NOT_AFTER_NAME = re.compile(
    r"[ \t]+(?:(?i:street|avenue|road|lane|square|terrace|close|drive|court|park|hall|tower|bridge|station|airport|port|pier|harbou?r|island|bay|beach|river|lake|creek|falls|valley|hill|mount(?:ain)?|forest|county|tide|gauge|observatory|museum|gallery|theatre|hospital|clinic|church|school|college|university|institute|foundation|association|society|museum"
    r"|gmbh|inc|ltd|llc|plc|ag|sa|sarl|corp|group|company|labs?|systems|software|technologies|partners|project|library|framework|module|package|plugin|server|service|engine|release|edition|licen[cs]e|protocol|algorithm|theorem|method|test|transform|filter|index|award|prize)\b|\d{1,4}[a-z]?\b)"
)


def _productive(names: Iterable[str]) -> set[str]:
    """Names that the lexicon's own parts make: beginnings and endings that each occur often."""
    pairs: dict[str, set[str]] = defaultdict(set)
    for n in names:
        if n.isalpha():
            for k in range(3, len(n) - 1):
                pairs[n[:k]].add(n[k:])
    heads = {h: t for h, t in pairs.items() if len(t) >= 4}
    tails: dict[str, set[str]] = defaultdict(set)
    for h, ts in heads.items():
        for t in ts:
            tails[t].add(h)
    good = {t for t, hs in tails.items() if len(hs) >= 4 and len(t) >= 2}
    out = set()
    for h, ts in heads.items():
        # the longest head that splits a name well: half of its endings are productive
        if len(h) >= 3 and len(ts & good) * 2 >= len(ts):
            out |= {h + t for t in good}
    return out


class Finder:
    """All anchors in one automaton; ``names``: pairs (name, 'given' or 'family')."""

    def __init__(self, names: Iterable[tuple[str, str]], ordinary: Iterable[str] = ()) -> None:
        self.ordinary = frozenset(ordinary)
        lexicon = [(n, p) for n, p in names if n]
        self.given = {n.lower() for n, p in lexicon if p == "given"}
        self.family = {n.lower() for n, p in lexicon if p == "family"}
        self.listed = self.given | self.family
        more_given = {n.lower() for n in _productive(n for n, p in lexicon if p == "given")} - self.listed
        more_family = {n.lower() for n in _productive(n for n, p in lexicon if p == "family")} - self.listed
        self.given |= more_given
        self.family |= more_family
        kinds: dict[str, set[str]] = defaultdict(set)
        for w in ("@", "%40", "&#64;", "&#x40;", "&commat;", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " at ", "\nat ", " at\n", " at\r"):
            kinds[w].add("email")
        for w in _ID_ANCHORS:
            kinds[w].add("id")
        for k, words in _ADDRESS_ANCHORS.items():
            for w in words:
                kinds[w].add(k)
        for w in _TITLES:
            for end in (" ", ".", "\n", "\r"):
                kinds[w.rstrip(".") + end].add("title")
        for w in _CUES:
            kinds[w].add("cue")
        for w in _SAID:
            kinds[w].add("said")
        for w in "0123456789":
            kinds[w].add("number")
        for w in self.given:
            kinds[w].add("given")
        for w in self.family:
            kinds[w].add("family")
        self.auto = ahocorasick.Automaton()
        for w, k in kinds.items():
            self.auto.add_word(w, (len(w), tuple(sorted(k))))
        self.auto.make_automaton()

    # -- local parsers; each yields (start, end, type) --

    def _email(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        lo = max(0, a - 90)
        for m in _EMAIL.finditer(t, lo, min(len(t), b + 160)):
            if m.start("at") > b:
                break
            if m.end("at") < a:
                continue
            plain = _PLAIN_AT.fullmatch(m["at"]) is not None
            host = m["host"]
            if plain and not re.search(r"(?i)[(\[{]\s*dot|\sdot\s", host):
                continue  # "meet at example.org" is no address
            end = m.end()
            tail = host.rsplit(".", 1)[-1]
            if m["at"] == "@":
                host_m = re.match(r"[A-Za-z0-9.-]+[A-Za-z0-9]", t[m.start("host") : m.end()])
                if host_m and not re.search(r"(?i)dot", host[len(host_m[0]) :]):
                    end = m.start("host") + len(host_m[0])
                    tail = host_m[0].rsplit(".", 1)[-1] if "." in host_m[0] else ""
                if not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]{1,23}", tail) or _EMAIL_ROBOT.match(m["local"]):
                    continue
            if _EMAIL_NOT_AFTER.match(t, end) and m["at"] == "@":
                continue
            before = t[max(0, m.start() - 24) : m.start()]
            if re.search(r"://(?:[^\s/@]*:)?$|(?:ssh|scp|rsync|git clone|docker login)\s+\S*$", before) or before.endswith(("://", "/")):
                continue
            yield m.start("local"), end, "email"

    def _id(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if b - a == 3 and t[b : b + 1].isalpha():
            return
        lo = max(0, a - 2)
        for cue, value in _ID_VALUES:
            for m in cue.finditer(t, lo, min(len(t), b + 30)):
                if m.start() > b or (m.start() and t[m.start() - 1].isalnum()):
                    continue
                j = _ID_JOIN.match(t, m.end())
                v = value.match(t, j.end())
                if v and sum(c.isdigit() for c in v[0]) >= 3 - 2 * ("ausweis" in cue.pattern) and not re.match(r"[\w]", t[v.end() : v.end() + 1] or " ") and (j.end() > m.end()):
                    yield v.start(), v.end(), "id_number"

    def _near(self, rx: re.Pattern[str], t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        for m in rx.finditer(t, max(0, a - 70), min(len(t), b + 90)):
            if m.start() <= b and m.end() >= a:
                yield m.start(), m.end(), "address"

    def _address_en(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if t[b - 1 - (t[b - 1] == ".")].isalpha() and (t[a].isupper() or t[a + 1].isupper()) and not t[b : b + 1].isalnum() and any(map(str.isdigit, t[max(0, a - 60) : a])):
            yield from self._near(_ADDRESSES[0], t, a, b)

    def _address_fr(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if not t[a - 1 : a].isalnum() and not t[b : b + 1].isalnum() and _NUMBER_NEAR_LEFT.search(t, max(0, a - 24), a):
            yield from self._near(_ADDRESSES[1], t, a, b)

    def _address_de(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if _NUMBER_NEAR_RIGHT.match(t, b):
            yield from self._near(_ADDRESSES[2], t, a, b)

    def _address_am(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if t[a].isupper() and not t[a - 1 : a].isalnum() and any(map(str.isdigit, t[b : b + 40])):
            yield from self._near(_ADDRESSES[2], t, a, b)
            yield from self._near(_ADDRESSES[3], t, a, b)

    def _address_es(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if not t[a - 1 : a].isalnum() and any(map(str.isdigit, t[b : b + 80])):
            yield from self._near(_ADDRESSES[4], t, a, b)

    def _title(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if not t[a].isupper():
            return
        m = _TITLE_RX.match(t, a)
        if not m or _TITLE_BEFORE.search(t, max(0, a - 24), a):
            return  # none, or read with the title before it
        at = m.end()
        while n := _TITLE_RX.match(t, at):
            at = n.end()
        n = _TITLED.match(t, at)
        if n and n[0].split()[-1].lower() not in _NOT_GIVEN:
            if t[a:at].strip() in ("M.", "M", "Don", "Sir") and n["last"].lower() not in self.family:
                return
            yield n.start(), n.end(), "name"

    def _cue(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        n = _FULL.match(t, b + (t[b : b + 1] == " "))
        if n and n["first"].lower() not in _NOT_GIVEN and not _ROLES & {n["first"].lower(), n["second"].lower()} and (t[a:b].lower() != "contact " or n["second"].lower() in self.family or n["first"].lower() in self.given):
            yield n.start(), n.end(), "name"

    def _said(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        n = _SPEAKER.search(t, max(0, a - 80), a)
        if n and not _ROLES & {n["first"].lower(), n["second"].lower()} and not {n["first"].lower(), n["second"].lower()} & (_NOT_GIVEN | self.ordinary):
            yield n.start("first"), n.end("second"), "name"

    def _number(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        """At the first digit of a run: account, identity and telephone numbers."""
        if t[max(0, a - 2) : a].isalpha() and t[a - 2 : a].isupper() and not t[a - 3 : a - 2].isalnum() and (m := _IBAN.match(t, a - 2)) and _mod97(m[0]):
            yield m.start(), m.end(), "account"
            return
        start = a
        while a and t[a - 1] in "(+" and start - a < 2:
            a -= 1
        if a and (t[a - 1].isalnum() or t[a - 1] in "_./+-#@$"):
            return
        m = _CARD.match(t, start)
        if m and (m["g"] or m["h"] or _CARD_CUE.search(t, max(0, start - 40), start)) and _luhn(m[0]):
            yield start, m.end(), "account"
            return
        n = _IDS_PLAIN.match(t, a)
        if n and (not n["check"] or _CHECK_LETTERS[int(t[a : a + 8]) % 23] == n["check"]):
            yield a, n.end(), "id_number"
            return
        end = start + 1
        while t[end : end + 1].isdigit():
            end += 1
        if end - start == 2 and (n := _NI_PLAIN.search(t, max(0, a - 5), a + 24)) and n.start() < a:
            yield n.start(), n.end(), "id_number"
            return
        n = _PHONE.match(t, a)
        if n and 7 <= sum(c.isdigit() for c in n[0]) <= 20 and not _PHONE_NOT_BEFORE.search(t, max(0, a - 30), a):
            local = _LOCAL.fullmatch(n[0])
            if not local or local["exchange"] == "555" or _PHONE_CUE.search(t, max(0, a - 24), a):
                yield a, n.end(), "phone"

    def _given(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        word = t[a:b]
        if not word[0].isupper() or not _apart(t, a, b):
            return
        common = word.lower() in self.ordinary
        n = _AFTER_GIVEN.match(t, b)
        if n:
            last = n["last"]
            known = last and last.lower() in self.family
            if last and last.lower() not in _NOT_GIVEN and (known or not common) and (known or not _NOT_AFTER_NAME.match(t, n.end())):
                yield a, n.end(), "name"
                return
            if not last and not common:
                yield a, n.end(), "name"
                return
            if not last and n["mid"]:
                yield a, n.end(), "name"
                return
        n = _BEFORE_GIVEN.search(t, max(0, a - 60), a)
        if n and n["last"].lower() not in _NOT_GIVEN and (n["last"].lower() in self.family or not common):
            yield n.start(), b, "name"

    def _family(self, t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
        if not (t[a].isupper() or t[a:b].split()[-1][0].isupper()) or not _apart(t, a, b):
            return
        common = t[a:b].lower() in self.ordinary
        if _NOT_AFTER_NAME.match(t, b):
            return
        n = _BEFORE_FAMILY.search(t, max(0, a - 60), a)
        if n:
            first = n["first"]
            if len(first) == 2 and first.endswith("."):
                if not common or (t[n.start() - 1 : n.start()] in ("", "\n", "\t", "|", ">", "\"", "(") and re.match(r"[ \t]*(?:[\r\n<|;\")]|$)", t[b:])):
                    yield n.start(), b, "name"
                    return
            elif first.lower() in self.given or (first.lower() not in _NOT_GIVEN and not common and len(first) > 2 and first.lower() not in self.ordinary):
                yield n.start(), b, "name"
                return
        n = _COMMA_GIVEN.match(t, b)
        if n and not common:
            first = n["first"].lower()
            if first in self.given or re.fullmatch(_INITIAL, n["first"]) or ("\n" not in n[0] and len(first) > 3 and first not in _NOT_GIVEN):
                yield a, n.end(), "name"

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """Items of a text, in order, without overlaps."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        got: set[tuple[int, int, str]] = set()
        parsers = {"email": self._email, "id": self._id, **{k: getattr(self, "_" + k) for k in _ADDRESS_ANCHORS}, "title": self._title, "cue": self._cue, "said": self._said, "number": self._number, "given": self._given, "family": self._family}
        for last, (n, kinds) in self.auto.iter(low):
            a, b = last + 1 - n, last + 1
            for k in kinds:
                if k == "number" and a and low[a - 1].isdigit():
                    continue
                if k in ("id", "title", "given", "family") and a and (low[a - 1].isalnum() or low[a - 1] == "_"):
                    continue
                got.update(parsers[k](text, a, b))
        # sweep: accepted items are disjoint and sorted, so only the two neighbours can be in the way
        out: list[tuple[int, int, str]] = []
        for a, b, k in sorted(got, key=lambda s: (_RANK[s[2]], s[0] - s[1], s[0])):
            at = bisect_left(out, (a, b, k))
            if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or out[at][0] >= b):
                insort(out, (a, b, k))
        return out


def _luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10


def _mod97(number: str) -> bool:
    solid = re.sub("[ -]", "", number)
    return 15 <= len(solid) <= 34 and int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97 == 1


_TITLED = re.compile(rf"(?:(?:{_INITIAL}|{_WORD}){_GAP})??(?P<last>{_FAMILY})(?![\w@])")
_FULL = re.compile(rf"(?P<first>{_WORD}|{_INITIAL})(?:,{_GAP}|{_GAP}(?:{_INITIAL}{_GAP})?)(?P<second>{_FAMILY}|{_INITIAL})(?![\w@])")
_AFTER_GIVEN = re.compile(rf"{_GAP}(?:(?P<mid>{_INITIAL})(?:{_GAP}|(?=[^\w]|$)))?(?P<last>{_FAMILY}(?![\w@]))?(?<=[\w.])")
_BEFORE_GIVEN = re.compile(rf"(?<![\w@.])(?P<last>{_FAMILY}),{_GAP}$")
_BEFORE_FAMILY = re.compile(rf"(?<![\w@])(?P<first>{_WORD}|{_INITIAL}){_GAP}(?:{_INITIAL}{_GAP})?(?:(?:de|van|von|der|la|DE|VAN|VON|DER|LA){_GAP})*$")
_COMMA_GIVEN = re.compile(rf",{_GAP}(?P<first>{_WORD}|{_INITIAL})(?![\w@])")
_SPEAKER = re.compile(rf"(?<![\w@.-])(?P<first>{_WORD}){_GAP}(?:{_INITIAL}{_GAP})?(?P<second>{_FAMILY})[ \t]*(?:<[^<>\n]*>[ \t]*)?(?:(?:hat|has|a)[ \t]+)?$")


def _apart(t: str, a: int, b: int) -> bool:
    before, after = t[a - 1 : a], t[b : b + 1]
    return not (before and (before.isalnum() or before in "_@.+-/")) and not (after and (after.isalnum() or after in "_@" or (after in ".+-" and t[b + 1 : b + 2].isalnum())))


def mask(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """The text with a typed placeholder for each item and nothing else changed."""
    if not text or not items:
        return text
    out, at = [], 0
    for a, b, kind in items:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


_STANDALONE = re.compile(r"(?<![\w@./+#-])[^\W\d_]+(?![\w@/]|[.+-]\w)")


def _lexicon(lexicon: DataFrame, max_names: int) -> list[tuple[str, str]]:
    names = [(r[0], r[1]) for r in lexicon.select("name", "name_part").where(F.col("name").isNotNull()).limit(max_names + 1).collect()]
    if len(names) > max_names:
        raise ValueError(f"the lexicon has more than {max_names} names; give a larger max_names if the executors can hold them")
    return names


def word_use(df: DataFrame, lexicon: DataFrame, text_col: str = "text", max_names: int = 200_000) -> DataFrame:
    """name, n_lower, n_capital: how often the corpus writes each known name, standing alone, in
    lower case and with a capital.  One row a name and task is shuffled."""
    known = {n.lower() for n, _ in _lexicon(lexicon, max_names) if n.isalpha()}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = ahocorasick.Automaton()
        for n in known:
            auto.add_word(n, len(n))
        auto.make_automaton()
        lower, capital = Counter(), Counter()
        for pdf in it:
            for text in pdf["text"]:
                low = text.lower()
                if len(low) != len(text):
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                for last, n in auto.iter(low) if len(auto) else ():
                    a, b = last + 1 - n, last + 1
                    if (m := _STANDALONE.match(text, a)) and m.end() == b:
                        (capital if text[a].isupper() else lower)[low[a:b]] += 1
        yield pd.DataFrame([(w, lower[w], capital[w]) for w in lower.keys() | capital.keys()], columns=["name", "n_lower", "n_capital"])

    rows = df.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
    counts = rows.mapInPandas(run, "name string, n_lower bigint, n_capital bigint")
    return counts.groupBy("name").agg(F.sum("n_lower").alias("n_lower"), F.sum("n_capital").alias("n_capital"))


def scan(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = True, max_names: int = 200_000) -> DataFrame:
    """Rows with personal information: id, items (line_no, start, length, pii_type), masked text.

    ``lexicon`` (name, name_part) becomes part of the automaton; its size is checked against
    ``max_names`` before it goes to the executors, and bounds the ordinary words among it, which
    a first pass counts over all documents.  The texts are not shuffled.
    """
    names = _lexicon(lexicon, max_names)
    ordinary = [r[0] for r in word_use(df, lexicon, text_col, max_names).where("n_lower > n_capital").select("name").collect()]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(names, ordinary)
        for pdf in it:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                items = finder.find(text)
                if items:
                    n, at, lines = 1, 0, []
                    for a, b, kind in items:
                        n += text.count("\n", at, a)
                        at = a
                        lines.append({"line_no": n, "start": a, "length": b - a, "pii_type": kind})
                    out.append((i, lines, mask(text, items) if masked else None))
            yield pd.DataFrame(out, columns=[id_col, "items", "masked"])

    id_type = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"{id_col} {id_type}, items array<struct<line_no:bigint,start:bigint,length:bigint,pii_type:string>>, masked string")


def found_lines(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each (id, line_no, pii_type) once on which an item of the five personal types begins."""
    return scan(df, lexicon, id_col, text_col, masked=False).select(id_col, F.explode("items").alias("i")).select(id_col, "i.line_no", "i.pii_type").where(F.col("pii_type").isin(*PERSONAL)).distinct()
