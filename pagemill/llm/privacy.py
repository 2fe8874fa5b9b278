"""Problem 5: personal information inside free text.

Anchor expansion: one Aho-Corasick pass over the folded text finds at-signs, schemes, identifier cues, parts of addresses,
openings of telephone and account numbers, given names and words that stand beside names. At each anchor a
deterministic parser expands to the left or right and validates what it finds: the parts of an e-mail address, the
digit groups of a telephone number from its opening (a plus sign, a bracket, a leading zero, a group before a separator), the
shape of an identity number, the check digits of a bank account or card, the order of street, number, postcode and
town within the anchor's paragraph, the form of a name. Offsets lead back to the stored text, in
which only the found spans are replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[PERSON]``.

Defined results: null stays null, empty stays empty; overlapping finds count for the kind that is checked first
(e-mail, identity number, address, telephone, person); a text is read whole, whatever its length; repeated rows give the
same text; existing columns of the output's names are refused with ValueError.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.arrow import slices
from pagemill.llm.lookalike import IGNORABLE, TO_LATIN
from pagemill.sources.tables import table

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Words before an identity number.
ID_CUES = (
    "passport no", "passport number", "passport", "national insurance number", "staff id", "staff number", "employee id", "employee number", "tax id", "tax number", "social security number", "ssn",
    "domain account", "personalnummer", "steuer-id", "steuernummer", "ausweisnummer", "reisepassnummer", "passnummer", "domänenkonto", "benutzerkonto", "sozialversicherungsnummer",
    "matricule", "passeport", "numéro fiscal", "numéro de sécurité sociale", "compte de domaine", "compte du domaine", "身分證字號", "身分證號", "統一證號", "居留證號", "護照號碼", "護照號", "網域帳號", "員工編號", "職員編號", "稅籍編號",
    "個人番号", "マイナンバー", "旅券番号", "職員番号", "社員番号", "ドメインアカウント", "納税者番号",
)
# Words that tell a number is none of a person.
OTHER_NUMBERS = (
    "serial", "batch", "order number", "order no", "invoice", "record", "file", "form", "seriennummer", "charge", "bestell", "vorgang", "akte", "formular", "numéro de série", "commande", "dossier", "lot",
    "序號", "批號", "訂單", "案號", "卷號", "卷宗", "編號", "製造番号", "注文", "ロット", "案件", "書類",
)
PHONE_CUES = ("tel", "phone", "ring", "call", "fax", "mobile", "joignable", "appel", "erreichbar", "anruf", "rufnummer", "電話", "可撥", "來電", "致電", "手機", "携帯")
# Common given names of the languages written in Latin letters (names that are also other words are left out).
GIVEN = (
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony steven paul andrew peter george edward brian kevin kenneth joshua timothy jeffrey ryan jacob nicholas jonathan stephen samuel benjamin patrick alexander henry oliver simon martin philip hugh "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret betty sandra ashley emily emma olivia sophie alice anna helen laura rachel julia maria jane ruth diana fiona lucy eleanor "
    "hans klaus jürgen wolfgang andreas stefan christian markus matthias sebastian tobias florian uwe dieter heinz karl kurt werner jens sabine petra monika ursula heike anja katrin claudia birgit renate ingrid susanne ulrike gisela brigitte "
    "jean pierre michel philippe jacques françois laurent nicolas olivier julien antoine louis marie nathalie isabelle sylvie catherine céline véronique sandrine valérie camille chloé élodie aurélie "
    "carlos josé juan luis miguel antonio manuel carmen lucía elena giovanni marco paolo giulia"
).split()
# What stands right before or right after a name.
NAME_BEFORE = (
    "ms. ", "mr. ", "mrs. ", "dr. ", "frau ", "herr ", "herrn ", "mme ", "m. ", "signed by ", "handed in by ", "submitted by ", "in by ", "badge for ", "name: ", "name:", "nom : ", "contact: ", "remis par ", "signée par ", "signé par ",
    "hat ", "von ", "聯絡人", "姓名", "氏名", "由", "|",
)
NAME_AFTER = (" lives ", " moved ", " holds ", " resides ", " gegengezeichnet", " unterschrieben", " wohnt ", " habite ", " demande ", "女士", "先生", "小姐", "已遷", "遷至", "送交", "複核並", "さん", "様が", "氏が", "(", "|", " (", " |")
# Common Chinese family names.
FAMILY = (
    "陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐周葉蘇莊呂江何蕭羅高潘簡朱鍾游彭詹胡施沈余盧梁趙顏柯翁魏孫戴范方宋鄧杜傅侯曹薛丁卓阮馬董溫唐藍石蔣田康姚鄒白紀湯尤古巫連金程嚴涂辜邸歐倪駱童甘尹章汪韓馮袁黎龔任"
    "姜鐘官向武錢秦符俞邵鮑包樊夏萬賀龍段管樓喬常熊孔毛邢葛尚柳陸季文牛岳左齊單祝華凌霍覃包談盛項安成史顧封粘麥易"
)

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_PART = rf"(?:[{_UP}][{_LOW}]+(?:['’\-][{_UP}]?[{_LOW}]+)*|[{_UP}]{{2,}}(?:['’\-][{_UP}]+)*)"
_LATIN = rf"(?:{_PART},\s{_PART}(?:\s[{_UP}]\.)?|{_PART}(?:\s[{_UP}]\.){{0,2}}\s{_PART})"
_GIVEN_AT = re.compile(rf"{_PART}(?:\s[{_UP}]\.){{0,2}}(?:\s(?:von|van|de|da|di|du|del|la|le))?\s{_PART}(?![{_LOW}])")
_NAME_AT = re.compile(rf"\s*({_LATIN})(?![{_LOW}])")
_NAME_TO = re.compile(rf"(?<![{_UP}{_LOW}\-])({_LATIN})\s*[<«\"(]*(?:mailto:)?$")
_HAN_NAME = re.compile(rf"([{FAMILY}][㐀-鿿]{{1,2}}|(?:歐陽|司徒|上官|諸葛|張簡)[㐀-鿿]{{1,2}})$")
_HAN_NAME_AT = re.compile(rf"\s*[:：]?\s*([{FAMILY}][㐀-鿿]{{2}}|[{FAMILY}][㐀-鿿](?=[\s|,，(]))")
_JA_NAME = re.compile(r"(?:^|[^㐀-鿿々])([㐀-鿿々ヶ]{1,4} ?[㐀-鿿々ぁ-ゖ]{1,4})$")
_ROLE = re.compile(r"(?:者|係|長|員|客|様|皆|班|室|課|部|所|局|科|組|股)$")
#: Capitalised words that open sentences or name units, not people.
_NO_NAME = frozenset(
    "The A An If In On At For From Until When Where While After Before During Each Every Please Reviewed Ms Mr Mrs Dr According Write Quote Serial Batch Open Select Move Use Two One Laut Nach Bei Bis Ab Der Die Das Im Am Auf Le La Les Un Une Si Pour Office Team Desk Room Unit Centre Group Board Pool Section".split()
)
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*$"), re.compile(r"\s?[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*")
_ID_VALUE = re.compile(r"[\s:：.#(]*(?:(?:no|nr|number|n°|nº|id|is|lautet)(?![A-Za-z])[.:]?)?[\s:：]*((?:[A-Za-z][A-Za-z0-9_.\-]*\\[A-Za-z0-9_.\-]*[A-Za-z0-9_])|[A-Z]{0,4}(?:[ \-]?\d[\dA-Z]*)+(?:[ \-][A-Z](?![\w]))?)(?![A-Za-z\d])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9\\])[A-Za-z][A-Za-z0-9\-]{1,20}\\[A-Za-z][A-Za-z0-9_.\-]*\d(?:[A-Za-z0-9_.\-]*[A-Za-z0-9_])?")
_SHAPES = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2} \d\d \d\d \d\d [A-D]|[A-Z][1289]\d{8})(?![A-Za-z0-9])")
_PHONE = re.compile(
    r"(?<![A-Za-z0-9.,/+\-])(?:\+\d{1,3}[ \-.]?(?:\(0\)[ \-.]?)?(?:\(?\d{1,4}\)?[ \-./]?){2,5}\d{2,}|\(0\d{0,3}\) ?\d{3,4}[ \-]?\d{3,4}|\(\d{3}\) ?\d{3}[ \-]\d{4}|0\d{1,4}(?:[ \-./]\d{2,8}){1,4}|0\d{8,10}|\d{3}([-. ])\d{3}\1\d{4})"
    r"(?:-\d{1,4})?(?:\s?(?:ext\.?|extension|x|轉|分機|内線|Durchwahl|poste)\s?\d{1,6})?(?!\d)"
)
_TOWN = rf"[{_UP}][{_LOW}]+(?:(?:[ \-](?:le|la|les|sur|sous|en|am|an|der|bei|upon|de|du))*[ \-][{_UP}][{_LOW}]+)*"
_WAYS = "Lane|Row|Road|Street|Avenue|Close|Drive|Way|Court|Terrace|Square|Crescent|Place|Gardens|Hill|Grove|Walk|Mews|Boulevard"
_ADDRESSES = (
    re.compile(rf"(?:P\. ?O\. ?Box|PO Box)\s\d+(?:,\s[{_UP}][\w'\-]*(?:\s[{_UP}][\w'\-]*)*(?:\s\d+[A-Za-z]?)?)?(?:,\s{_TOWN})?(?:,?\s[A-Z]{{2}}\s\d{{4,5}})?"),
    re.compile(rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\d+[A-Za-z]?,\s)?\d+[A-Za-z]?\s(?:[{_UP}][\w'\-]*\s){{1,3}}(?:{_WAYS})(?:,\s{_TOWN})?(?:,?\s[A-Z]{{2}}\s\d{{4,5}})?"),
    re.compile(rf"(?:[{_UP}][{_LOW}\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|graben|steig))\s\d+(?:\s?[a-z](?![A-Za-zÀ-ÿ]))?(?:,\s\d{{5}}\s{_TOWN})?"),
    re.compile(rf"(?:(?:Am|An der|Im|Auf dem|Zum|Zur|Unter den|[{_UP}][{_LOW}\-]+)\s){{0,2}}[{_UP}][{_LOW}\-]+\s\d+(?:\s?[a-z])?,\s\d{{5}}\s{_TOWN}"),
    re.compile(rf"Postfach\s\d[\d ]*(?:,\s\d{{5}}\s{_TOWN})?"),
    re.compile(rf"\d+(?:\s(?:bis|ter|quater))?,?\s(?:rue|allée|chemin|avenue|boulevard|impasse|place|quai|cours|route|square|passage)\s[^\d,\n]{{3,40}}?(?:,\s\d{{5}}\s{_TOWN}(?:\sCedex)?|(?=[.;\n]))"),
    re.compile(rf"(?:BP|B\.P\.|boîte postale)\s\d+(?:,\s\d{{5}}\s{_TOWN})?"),
    re.compile(r"(?:\d{3,6} ?)?[㐀-鿿]{2}[市縣](?:[㐀-鿿]{1,3}[區鄉鎮市])?(?:[㐀-鿿]{1,3}[里村])?(?:\d+鄰)?(?:[㐀-鿿]{1,6}?(?:大道|路|街|巷|弄)(?:[一二三四五六七八九十\d]{1,3}段)?)(?:\d+巷)?(?:\d+弄)?\d+(?:之\d+)?號(?:地下)?(?:之\d+樓|之\d+|\d+樓)*"),
    re.compile(r"(?:[㐀-鿿]{2}[市縣][㐀-鿿]{0,8})?(?:郵政)?(?:第 ?)?\d*號?信箱(?:第 ?)?\d+號?|[㐀-鿿]{2,10}郵局(?:第 ?)?\d+號信箱"),
    re.compile(r"(?:〒? ?\d{3}-\d{4} ?)?[㐀-鿿]{2,3}[都道府県][㐀-鿿ヶ]{1,5}[市区郡町村](?:[㐀-鿿ヶ]{1,4}[区町村])?[㐀-鿿ぁ-ヿ]{0,8}?\d+(?:丁目|番地?|号|-)(?:\d+(?:番地?|号|-)?)*(?:の\d+)?(?: ?[^\s、。]{0,10}?\d+(?:号室|階))?"),
    re.compile(r"(?:[㐀-鿿]{2,10}郵便局)?私書箱(?:第 ?)?\d+号?"),
)

#: For each form of an address, groups of which the text must hold one part each; without them its parser has no anchor.
_PARTS = (
    (("Box",),),
    (tuple(f" {w}" for w in _WAYS.split("|")),),
    (("straße", "strasse", "str.", "weg ", "gasse ", "platz ", "allee ", "ring ", "ufer ", "damm ", "graben ", "steig "),),
    ((",",), tuple(f"{d} " for d in range(10))),
    (("Postfach",),),
    (("rue ", "allée ", "chemin ", "avenue ", "boulevard ", "impasse ", "place ", "quai ", "cours ", "route ", "square ", "passage "),),
    (("BP ", "B.P.", "boîte postale"),),
    (("號",), ("市", "縣"), ("路", "街", "大道", "巷", "弄")),
    (("信箱",),),
    (("都", "道", "府", "県"), ("市", "区", "郡", "町", "村"), ("丁目", "番", "号", "-")),
    (("私書箱",),),
)
_POSTCODE = re.compile(r",\s\d{5}\s")

_E, _I, _P, _A, _B, _C, _S, _G = range(8)
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Openings of telephone numbers: a plus sign, a bracket or a leading zero before a digit, and a digit group before a separator.
_OPENINGS = (*(f"{x}{d}" for x in "+(0" for d in _DIGITS), *(f"{a}{x}{b}" for x in "-. " for a in _DIGITS for b in _DIGITS))
#: Openings of identity and account numbers by their shape: letters before a digit.
_SHAPE_OPENINGS = (*(f"{x}{d}" for x in _LETTERS for d in _DIGITS), *(f"{x} {d}" for x in _LETTERS for d in _DIGITS))
#: Parts of addresses that anchor each form; the fourth is anchored at its postcode.
_ADDRESS_ANCHORS = tuple(tuple(f",{x}{d}" for x in " \n" for d in _DIGITS) if k == 3 else tuple(x.lower() for x in parts[0]) for k, parts in enumerate(_PARTS))


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    groups = ((_E, ("@", "(at)", "[at]", "mailto:")), (_I, (*ID_CUES, "\\")), (_P, _OPENINGS), (_B, NAME_BEFORE), (_C, NAME_AFTER), (_S, _SHAPE_OPENINGS), (_G, tuple(f"{x} " for x in GIVEN)))
    for kind, cues in groups:
        for cue in cues:
            found.setdefault(cue, [[], []])[0].append(kind)
    for k, cues in enumerate(_ADDRESS_ANCHORS):
        for cue in cues:
            found.setdefault(cue, [[], []])[1].append(k)
    out = ahocorasick.Automaton()
    for cue, (kinds, forms) in found.items():
        out.add_word(cue, (len(cue), tuple(kinds), tuple(forms)))
    out.make_automaton()
    return out


class _Taken:
    """Spans without overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True

    def begins(self, low: int, high: int) -> bool:
        """Whether a span begins in [low, high]."""
        i = bisect_left(self.starts, low)
        return i < len(self.starts) and self.starts[i] <= high


def _account_ok(text: str) -> bool:
    """The check digits of an international bank account number."""
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _card_ok(text: str) -> bool:
    """The check digit of a card number."""
    d = [int(c) for c in text if c.isdigit()]
    return len(set(d)) > 1 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0


_BANK = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"[3-6]\d{3}([ -])\d{4}\1\d{4}\1\d{4}(?![A-Za-z0-9]|[ -]\d)")


def _paragraphs(text: str) -> list[int]:
    """Where paragraphs (between blank lines) start."""
    return [0, *(m.end() for m in _BLANK.finditer(text))]


_BLANK = re.compile(r"\n[ \t]*\n")

_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys((0x3000, 0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F), 32) | {0x2010: 45, 0x2011: 45, 0x2013: 45} | {ord(a): ord(b) for a, b in TO_LATIN.items()}
_SLOW = re.compile(rf"[{IGNORABLE}\ufb00-\ufb06\uff61-\uffdc\u0300-\u036f\u2f00-\u2fdf\uf900-\ufaff]")
_DROP = re.compile(rf"[{IGNORABLE}]")


@lru_cache(20_000)
def _flat(c: str) -> str:
    return unicodedata.normalize("NFKC", c).translate(_WIDTH)


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text without dirt, and for each of its characters the place in the stored text (null: the same)."""
    if text.isascii():
        return text, None
    if not _SLOW.search(text):
        return text.translate(_WIDTH), None
    out: list[str] = []
    where: list[int] = []
    for i, c in enumerate(text):
        if c < "\x7f":
            out.append(c)
            where.append(i)
            continue
        if _DROP.match(c):
            continue
        if out and unicodedata.combining(c) and len(both := unicodedata.normalize("NFC", out[-1] + c)) == 1:
            out[-1] = both
            continue
        for x in _flat(c):
            out.append(x)
            where.append(i)
    return "".join(out), where


def _name_ok(name: str) -> bool:
    parts = re.findall(rf"[{_UP}{_LOW}'’\-]+", name)
    return len(parts) >= 2 and not any(len(p) > 1 and p in _NO_NAME for p in parts)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the stored text, in order and without overlap."""
    plain, where = folded(text)
    lower = plain.lower()
    if len(lower) != len(plain):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    anchors: list[list[tuple[int, int]]] = [[] for _ in range(8)]
    places: list[set[int]] = [set() for _ in _ADDRESSES]
    paragraphs = _paragraphs(plain)
    for end, (size, kinds, forms) in _automaton().iter(lower):
        for kind in kinds:
            anchors[kind].append((end + 1 - size, end + 1))
        for k in forms:
            places[k].add(bisect_right(paragraphs, end + 1 - size) - 1)
    spans: list[tuple[int, int, str]] = []
    taken = _Taken()

    def add(a: int, b: int, kind: str) -> bool:
        if not taken.add(a, b):
            return False
        spans.append((a, b, kind))
        return True

    starts: list[int] = []  # places that a name may stand right before
    for a, b in anchors[_E]:
        if plain[a:b].lower() == "mailto:":
            continue
        left = plain[max(0, a - 80) : a].rstrip(" ") if b - a > 1 else plain[max(0, a - 80) : a]
        m, r = _LOCAL.search(left), _DOMAIN.match(plain, b)
        if not m or not r:
            continue
        if plain[b : b + 1] == " " and b - a == 1:
            continue
        domain = r[0].strip().rstrip(".-")
        end = r.start() + (len(r[0]) - len(r[0].lstrip())) + len(domain)
        last = domain.rpartition(".")[2]
        if "." in domain and last.isalpha() and len(last) >= 2 or end >= len(plain) - 1:
            begin = a - (len(plain[max(0, a - 80) : a]) - m.start())
            if add(begin, end, "email"):
                starts.append(begin)
    for a, b in anchors[_I]:
        if plain[a] == "\\":
            m = _ACCOUNT.search(plain, max(0, a - 24), a + 40)
            if m and m.start() < a < m.end():
                add(m.start(), m.end(), "id_number")
            continue
        starts.append(a)
        m = _ID_VALUE.match(plain, b)
        if m and ("\\" in m[1] or sum(map(str.isdigit, m[1])) >= 4):
            add(m.start(1), m.end(1), "id_number")
    for a, b in anchors[_S]:
        for begin in (a, a - 1):
            if begin < 0 or begin and (plain[begin - 1].isalnum() and plain[begin - 1].isascii()):
                continue
            if m := _SHAPES.match(plain, begin):
                add(m.start(), m.end(), "id_number")
            elif m := _BANK.match(plain, begin):
                groups = [m.end(), *(x for x in range(m.end() - 1, begin + 14, -1) if plain[x] == " ")]
                if end := next((x for x in groups if _account_ok(plain[begin:x])), 0):
                    add(begin, end, "id_number")
    for k, (pattern, parts) in enumerate(zip(_ADDRESSES, _PARTS, strict=True)):
        for at in sorted(places[k]):
            low, high = paragraphs[at], paragraphs[at + 1] if at + 1 < len(paragraphs) else len(plain)
            if not all(any(plain.find(x, low, high) >= 0 for x in group) for group in parts) or k == 3 and not _POSTCODE.search(plain, low, high):
                continue
            for m in pattern.finditer(plain, low, high):
                if add(m.start(), m.end(), "address"):
                    starts.append(m.start())
    done = 0
    for a, _ in anchors[_P]:
        # a digit group before a separator opens where the group begins
        while a and plain[a].isdigit() and plain[a - 1].isdigit():
            a -= 1
        if a < done:
            continue
        m = _PHONE.match(plain, a) or a and plain[a - 1] in "+(" and _PHONE.match(plain, a - 1)
        if not m:
            if (c := _CARD.match(plain, a)) and not plain[a - 1 : a].isalnum() and _card_ok(c[0]) and add(c.start(), c.end(), "id_number"):
                done = c.end()
            continue
        done = m.end()
        digits = sum(map(str.isdigit, re.split(r"(?i)ext|x|轉|分機|内線|durchwahl|poste", m[0])[0]))
        if not 8 <= digits <= 15:
            continue
        before = lower[max(0, m.start() - 18) : m.start()]
        other = max((before.rfind(c) for c in OTHER_NUMBERS), default=-1)
        cue = max((before.rfind(c) for c in PHONE_CUES), default=-1)
        if other > cue and other >= 0 and not m[0].startswith("+"):
            continue
        add(m.start(), m.end(), "phone")
    for a, b in anchors[_B]:
        cue = lower[a:b]
        m = _NAME_AT.match(plain, b) if cue[0] < "　" else None
        if m and (_name_ok(m[1]) if cue not in ("hat ", "von ", "|", "in by ", "m. ") else _name_ok(m[1]) and _beside(plain, m.end(1), taken)):
            add(m.start(1), m.end(1), "person")
        elif cue in ("聯絡人", "姓名", "氏名"):
            if m := _HAN_NAME_AT.match(plain, b):
                add(m.start(1), m.end(1), "person")
    for a, b in anchors[_C]:
        cue = lower[a:b]
        left = plain[max(0, a - 60) : a]
        shift = a - len(left)
        if cue in ("さん", "様が", "氏が"):
            m = _JA_NAME.search(left)
            if m and sum(c != " " for c in m[1]) >= 3 and not _ROLE.search(m[1]):
                add(shift + m.start(1), shift + m.end(1), "person")
            continue
        if cue[0] >= "　":
            m = _HAN_NAME.search(left)
            if m and not _ROLE.search(m[1]):
                add(shift + m.start(1), shift + m.end(1), "person")
            continue
        if cue.strip() in ("(", "|") and not any(b <= s <= b + 1 for s in starts):
            continue
        m = _NAME_TO.search(left)
        if m and _name_ok(m[1]):
            add(shift + m.start(1), shift + m.end(1), "person")
        elif m and (inner := re.search(rf"({_PART}(?:\s[{_UP}]\.)?\s{_PART})$", m[1])) and _name_ok(inner[1]):
            add(shift + m.start(1) + inner.start(1), shift + m.start(1) + inner.end(1), "person")
        elif m := _HAN_NAME.search(left.rstrip()):
            if not _ROLE.search(m[1]):
                add(shift + m.start(1), shift + m.end(1), "person")
    for a, _ in anchors[_G]:
        if plain[a].isupper() and not plain[a - 1 : a].isalpha():
            m = _GIVEN_AT.match(plain, a)
            if m and _name_ok(m[0]):
                add(m.start(), m.end(), "person")
    for s in starts:
        m = _NAME_TO.search(plain[max(0, s - 60) : s])
        if m and _name_ok(m[1]) and plain[s - 1] in "<:(":
            shift = s - len(plain[max(0, s - 60) : s])
            add(shift + m.start(1), shift + m.end(1), "person")
    spans.sort()
    if where is None:
        return spans
    return [(where[a], where[b - 1] + 1, k) for a, b, k in spans]


def _beside(plain: str, end: int, taken: _Taken) -> bool:
    """Whether something of a person, or a verb of signing, follows within a few characters."""
    after = plain[end : end + 40].lower()
    return taken.begins(end, end + 30) or "gegengezeichnet" in after or "unterschrieben" in after


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def mask_personal(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``masked`` (placeholders in place of what was found) and ``kinds`` (array of the kinds present)."""
    if clash := {"masked", "kinds"} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("masked", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column):
            masked, kinds = [], []
            for text in b.column(column).to_pylist():
                spans = find(text) if text else []
                masked.append(mask(text, spans) if spans else text)
                kinds.append(sorted({k for _, _, k in spans}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(masked, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=[*names, "masked", "kinds"])

    return df.mapInArrow(apply, schema)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "chunks").where("length(content) > 0").select("run_id", "chunk_id", "content")
    return mask_personal(texts, "content").select("run_id", "chunk_id", F.explode("kinds").alias("kind")).distinct()


def p5_masked(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's content with typed placeholders in place of personal information."""
    texts = table(spark, root, "chunks").select("run_id", "chunk_id", "content").distinct()
    return mask_personal(texts, "content").drop("content")
