"""Personal information in free text: found, and replaced by typed placeholders.

Regular expressions propose spans; checksums (Luhn, mod 97, mod 23, mod 11 and others) confirm them; words nearby raise
or lower their scores; what stays above the threshold counts. Names are found in two steps: structural contexts (labels,
titles, contact lines that hold a confirmed address, number or mail) teach given and family names. How often, in how many
kinds of contexts, and how often each word stands in strings of items instead, is counted over all texts; words that are
mostly items are no names. Then every capitalised sequence is looked up in what is left by a join, so the list of names
may be of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import bounded_broadcast, checkpointed

# ---------------------------------------------------------------- characters

_WIDE = {ord(a): b for a, b in zip("０１２３４５６７８９（）－＋＠．　／：，｜‐‑‒–—−", "0123456789()-+@. /:,|------", strict=True)}
_WIDE |= {0x0660 + i: str(i) for i in range(10)} | {0x06F0 + i: str(i) for i in range(10)} | {0x0966 + i: str(i) for i in range(10)} | {0x0E50 + i: str(i) for i in range(10)} | {0xA0: " ", 0x202F: " "}

# ---------------------------------------------------------------- validators


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personnummer(digits: str) -> bool:
    """Swedish identity: Luhn over the last ten digits."""
    return luhn(digits[-10:])


def nir_key(digits: str) -> bool:
    """French social security: 13 digits and their key mod 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def dni_letter(value: str) -> bool:
    """Spanish identity: eight digits and their letter mod 23."""
    d = re.sub(r"\W", "", value)
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(d[:8]) % 23] == d[8].upper()


def cn_check(value: str) -> bool:
    """Chinese identity: mod 11-2 over 17 digits."""
    total = sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(value[:17]))
    return "10X98765432"[total % 11] == value[17].upper()


def steuer_check(digits: str) -> bool:
    """German tax number: ISO 7064 mod 11,10."""
    p = 10
    for c in digits[:10]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[10])


def thai_check(digits: str) -> bool:
    return (11 - sum(int(c) * (13 - i) for i, c in enumerate(digits[:12])) % 11) % 10 == int(digits[12])


# ---------------------------------------------------------------- e-mail

_LABELS = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = re.compile(
    rf"[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?@ ?{_LABELS}(?:\.{_LABELS})*\.[A-Za-z]{{2,}}"
    rf"|\s?[(\[{{]\s?(?:at|AT|At)\s?[)\]}}]\s?{_LABELS}(?:(?:\s?[(\[{{]\s?(?:dot|DOT|Dot)\s?[)\]}}]\s?|\.){_LABELS})+"
    rf"|\s+(?:at|AT)\s+{_LABELS}(?:\s+(?:dot|DOT)\s+{_LABELS})+)"
)
_MAYBE_EMAIL = re.compile(r"@|[(\[{ ]\s?(?:at|AT|At)\s?[)\]} ]")

# ---------------------------------------------------------------- numbers

_CHUNK = re.compile(r"[+(]?\d[\d ().\-/]{5,}[\dA-Z]?")
#: (kind, score, pattern, validator). A pattern alone needs 0.5 to count; see _score.
_EXT = r"(?:\s?(?:ext\.?|x|Durchwahl|poste|int\.|доб\.)\s?\d{1,5})?"
_END = r"(?![A-Za-z0-9_/-]|\.\d)"
_NUMBERS: tuple[tuple[str, float, re.Pattern[str], object], ...] = tuple(
    (kind, score, re.compile(r"(?<![A-Za-z0-9_.,/+-])" + p + _END), check)
    for kind, score, p, check in (
        ("id_number", 0.6, r"\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", cn_check),
        ("id_number", 0.6, r"\d{3}-\d{4}-\d{7}-\d", None),
        ("id_number", 0.6, r"\d-\d{4}-\d{5}-\d{2}-\d", thai_check),
        ("id_number", 0.8, r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}", nir_key),
        ("id_number", 0.5, r"\d{8}[ -]?[A-HJ-NP-TV-Z]", dni_letter),
        ("id_number", 0.5, r"[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", None),
        ("id_number", 0.5, r"\d{3}-\d{2}-\d{4}", None),
        ("id_number", 0.65, r"\d{4}([- ])\d{4}\1\d{4}", None),
        ("id_number", 0.4, r"\d{3} \d{2} \d{4}", None),
        ("id_number", 0.15, r"\d{3}([- ])\d{3}\1\d{3}", luhn),
        ("id_number", 0.15, r"(?:19|20)?\d{6}[-+]\d{4}", personnummer),
        ("id_number", 0.65, r"0\d \d{3} \d{3} \d{3}", steuer_check),
        ("id_number", 0.35, r"\d{2} \d{3} \d{3} \d{3}", steuer_check),
        ("id_number", 0.5, r"[A-Z]\d{8}[A-Z]?", None),
        ("id_number", 0.3, r"\d{11}", steuer_check),
        ("id_number", 0.3, r"\d{12}", None),
        ("id_number", 0.3, r"\d{13}", thai_check),
        ("id_number", 0.3, r"[A-Z]{1,2} ?\d{6,9}[A-Z]?", None),
        ("id_number", 0.2, r"\d{9}", None),
        ("id_number", 0.2, r"\d{7,8}", None),
        ("phone", 0.7, r"(?:\+ ?|(?<!\d )00)[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,10}){0,5}" + _EXT, "international"),
        ("phone", 0.7, r"(?:1-)?\([2-9]\d{2}\) ?\d{3}[ .-]?\d{4}" + _EXT, None),
        ("phone", 0.6, r"(?:1[.-])?[2-9]\d{2}([.-])\d{3}\1\d{4}" + _EXT, None),
        ("phone", 0.6, r"\(0\d{1,4}\) ?\d{3,5}(?:[ -]?\d{2,5}){0,2}" + _EXT, None),
        ("phone", 0.6, r"0\d{1,4}/\d{3,8}(?:-\d{1,5})?", None),
        ("phone", 0.6, r"0[1-9](?:([ .-])\d{2})(?:\1\d{2}){3}" + _EXT, None),
        ("phone", 0.6, r"0\d{4} \d{3} \d{3}" + _EXT, None),
        ("phone", 0.6, r"[6-9]\d{2}([ -])\d{3}\1\d{3}", None),
        ("phone", 0.6, r"[6-9]\d{2} \d{2} \d{3} \d{2}", None),
        ("phone", 0.6, r"1\d{2}([- ])\d{4}\1\d{4}", None),
        ("phone", 0.6, r"0\d{1,3}\(\d{2,4}\)\d{4}", None),
        ("phone", 0.6, r"0\d{1,4}([- ])\d{2,4}\1\d{3,4}", None),
        ("phone", 0.6, r"0\d{2,3}[- ]\d{7,8}", None),
        ("phone", 0.55, r"\d{5}-\d{5}", None),
        ("phone", 0.5, r"1[3-9]\d{9}", None),
        ("phone", 0.5, r"[2-9]\d{2}[2-9]\d{6}", None),
        ("phone", 0.5, r"0[1-9]\d{8,9}", None),
        ("phone", 0.3, r"[6-9]\d{8}", None),
    )
)
#: Spans of years, dates, grouped amounts, network addresses.
_NO_ID = re.compile(r"(?:19|20)\d{2} ?- ?(?:19|20)\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|[1-9]\d{0,2}(?:\.\d{3})+|(?:\d{1,3}\.){3}\d{1,3}")
_ID_NEAR = re.compile(
    r"(?i)ssn|social security|insurance|passport|passnummer|reisepass|ausweis|steuer|tax (?:id|no|number)|identi(?:ty|fi)|sécurité sociale|n° ?ss\b|\bnir\b|\bn\.?i\.?[ef]\b|\bdni\b|passeport|pasaporte|social insurance|\bsin\b|personnummer|national id|nat\. ?id|\bid(?: card)?(?: no\.?| number)?\s?:"
    r"|身份证|身分證|护照|個人番号|マイナンバー|旅券|आधार|पासपोर्ट|هوي|الهوية|جواز|เลขบัตร|ประชาชน|หนังสือเดินทาง"
)
_PHONE_NEAR = re.compile(
    r"(?i)\btel|phone|mobil|cell|\bcall\b|\bring\b|\bfax|\bt:|handy|ruf|portable|appel|móvil|teléf|llam|电话|手机|電話|携帯|连絡|連絡|फ़ोन|फोन|मोबाइल|هاتف|جوال|اتص|โทร|โทรศัพท์|\boder\b|\bor\b|\bou\b"
)
_NOT_NEAR = re.compile(
    r"(?i)ticket|order|invoice|ref\.?\s*$|ref\b|rev\.|version|\bver\b|\brel\b|release|dossier|pedido|auftrag|az\.|host|\bip\b|工单|编号|案件|注文|請求|build|commit|bestell|factura|facture|budget|spent|presupuesto|isbn|bestand"
)
_COUNTRY = {"1": (10, 10), "33": (9, 10), "44": (10, 11), "49": (7, 12), "34": (9, 9), "86": (10, 11), "81": (9, 10), "91": (10, 10), "971": (8, 9), "66": (8, 9)}


def _international(value: str) -> int | None:
    """The length of the phone number at the start of value, by the digits its country allows; None if there is none."""
    m = re.match(r"(?:\+|00) ?", value)
    digits = re.sub(r"\D", "", value[m.end() :])
    code = next((c for c in (digits[:3], digits[:2], digits[:1]) if c in _COUNTRY), None)
    low, high = _COUNTRY.get(code, (7, 13))
    low, high = low + len(code or "0"), high + len(code or "0")
    body = re.split(r"(?i)\s?(?:ext|x|Durchwahl|poste|int)", value)[0]
    ext = value[len(body) :]
    while True:
        n = len(re.sub(r"\D", "", body[m.end() :]))
        if low <= n <= high:
            return len(body) + len(ext)
        if n < low:
            return None
        cut = max(body.rfind(c) for c in " .-")
        if cut <= m.end():
            return None
        body, ext = body[:cut], ""


def _score(kind: str, base: float, value: str, check: object, before: str, after: str) -> float:
    score = base
    if callable(check):
        digits = re.sub(r"\D", "", value) if check not in (cn_check, dni_letter) else value
        score += 0.3 if check(digits) else 0.0
    near_id, near_phone = list(_ID_NEAR.finditer(before)), list(_PHONE_NEAR.finditer(before))
    at_id, at_phone = (x[-1].end() if x else -1 for x in (near_id, near_phone))
    if _NOT_NEAR.search(before[max(at_id, at_phone, 0) :][-24:]):
        return 0.0
    if kind == "id_number":
        score += 0.4 if at_id > at_phone else -0.2 if at_phone > at_id else 0.0
    else:
        score += 0.3 if at_phone > at_id else -0.3 if at_id > at_phone else 0.0
    return score


def _numbers(t: str, taken: list[tuple[int, int, str]], out: list[tuple[int, int, str]]) -> None:
    for chunk in _CHUNK.finditer(t):
        if sum(map(str.isdigit, chunk[0])) < 6 or _NO_ID.fullmatch(chunk[0].strip()):
            continue
        low, high = max(0, chunk.start() - 4), min(len(t), chunk.end() + 16)
        while high < len(t) and t[high].isalnum():
            high += 1  # else a number that is cut here would look whole
        found = []
        for kind, base, p, check in _NUMBERS:
            for m in p.finditer(t, low, high):
                a, b = m.span()
                if any(a < y and x < b for x, y, _ in taken):
                    continue
                if check == "international":
                    n = _international(m[0])
                    if n is None:
                        continue
                    b = a + n
                    score = _score(kind, base, t[a:b], None, t[max(0, a - 44) : a], t[b : b + 12])
                else:
                    score = _score(kind, base, m[0], check, t[max(0, a - 44) : a], t[b : b + 12])
                if score >= 0.5:
                    found.append((score, b - a, a, b, kind))
        # of overlapping readings the likelier stays, of equally likely ones the longer
        found.sort(reverse=True)
        for _, _, a, b, kind in found:
            if not any(a < y and x < b for x, y, _ in taken):
                taken.append((a, b, kind))
                out.append((a, b, kind))


# ---------------------------------------------------------------- addresses

_UP = "A-ZÀ-ÖØ-Þ"
_W = rf"[{_UP}][\w'’-]*"
_TOWN = rf"(?:(?:Lake|Puerto|Saint|Sainte|San|Santa|New|Los|Las|Bad|Port|Fort|Mount|Villa|Upper|Lower|North|South|East|West|LAKE|PUERTO|SAINT|SAN|SANTA|NEW|PORT) )?(?!(?:Apt|Flat|Unit|Passport|PASSPORT|SSN|Tel|Mail|Phone|Mobile|Address)\b){_W}"
_CITY = rf"(?:, (?:\d{{5}} {_TOWN}|{_TOWN}(?: \d{{5}}(?!\d))?))?"
_FLAT = r"(?:Flat|Apt\.?|Unit|Suite|FLAT|APT\.?|UNIT|Room)"
_MONTH = r"(?i:januar|jänner|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jahr|quartal|abschnitt|abs|artikel|kapitel)"
_DE_WAYS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "stieg", "steig", "graben", "markt", "STRASSE", "STRAßE", "STR.", "WEG", "GASSE", "PLATZ", "ALLEE")
_DE_BEFORE = r"(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|AM|IM|ZUM|ZUR)"
_FR_NUMBER = r"(?: ?(?:bis|ter|quater|BIS|TER))?,? "
_FR_WAYS = r"(?:rue|av\.|avenue|bd|boulevard|chemin|place|quai|allée|impasse|route|cours|RUE|AV\.|BD|CHEMIN|PLACE|QUAI) "
_ES_WAYS = r"(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Ronda|Camino|Travesía|CALLE|AVDA\.?|PLAZA|PASEO) "
_STREETS = (
    rf"(?:{_FLAT} \d+\w?, )?\d{{1,4}}[A-Z]?(?:-\d{{1,4}})? (?:[NSEW]\. )?(?:{_W} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Row|Lane|Ln|Boulevard|Blvd|Drive|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Close|Walk"
    rf"|STREET|ST|ROAD|RD|AVENUE|AVE|ROW|LANE|LN|BOULEVARD|BLVD|DRIVE|COURT|WAY|PLACE|SQUARE)\b(?:(?<=St|Rd|Ct|Pl|Sq|Ln|ST|RD|LN)\.|(?<=Ave|AVE)\.|(?<=Blvd|BLVD)\.)?(?:, {_FLAT} ?\d+\w?)?{_CITY}",
    rf"(?:(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|ALTE|NEUE) )?[{_UP}][\w-]*(?:{'|'.join(map(re.escape, _DE_WAYS))})"
    rf"|{_DE_BEFORE} (?!{_MONTH}){_W}) \d{{1,3}}(?!\d)(?: ?[a-zA-Z]\b)?(?: ?[-/] ?\d{{1,4}}[a-z]?)?\b{_CITY}",
    rf"\d{{1,4}}{_FR_NUMBER}{_FR_WAYS}(?:(?:de la|de l'|du|des|de|d'|DE LA|DE L'|DU|DES|DE|D')\s?)?{_W}{_CITY}",
    rf"{_ES_WAYS}(?:(?:de la|de los|de las|del|de|DE LA|DEL|DE) )?{_W}(?: {_W})?,? (?:n\.?[º°] ?|núm\. ?|N\.?[º°] ?)?\d{{1,4}}(?:, \d{{1,2}}\.?[ºª](?: ?[A-Z]\b| (?:izq|dcha)\.?)?)?{_CITY}",
    r"(?:[一-鿿]{2,3}?省)?(?:[一-鿿]{2,3}?市)?(?:[一-鿿]{2,3}?[区县])?[一-鿿]{1,5}(?:大道|路|街|巷|胡同|道)(?:[一-鿿]{1,2}(?:路|街|巷))?\d{1,4}号(?:\d{1,3}(?:号楼|栋|幢|座|单元))*(?:\d{1,5}室)?",
    r"(?:[一-鿿]{2,3}[都道府県])?(?:[一-鿿]{1,4}[市区郡])?(?:[一-鿿]{1,4}[区町村])?[一-鿿ァ-ヶ]{1,5}(?:\d{1,2}丁目\d{1,3}番地?(?:\d{1,3}号?)?|\d{1,2}-\d{1,3}-\d{1,3}(?!-?\d))",
    r"मकान नं\.? ?\d{1,4},? [ऀ-ॿ]+(?: [ऀ-ॿ]+)? (?:रोड|गली|मार्ग|नगर|चौक|पथ|बाग)",
    r"(?:شارع|طريق|زقاق|درب|نهج) [؀-ۿ]+(?: [؀-ۿ]+){0,3}? رقم \d{1,4}",
    r"\d{1,4}(?:/\d{1,4})? (?:หมู่ \d{1,2} )?(?:ถนน|ซอย|ตรอก)[฀-๿]+",
)
#: Each country's pattern, and what must occur in a text for it to be tried: searches that begin with a digit or with
#: one of a few capitals, so they skip most of a text.
_ADDRESSES = tuple(re.compile(p if p[:6] == "(?:[一-" else rf"(?<![\w./])(?:{p})") for p in _STREETS)


# made of the parts of the patterns: what a pattern takes, its filter lets through
_NEAR_EN = re.compile(rf"\d[A-Z]? (?:[NSEW]\. )?[{_UP}]")
_NEAR_FR = re.compile(rf"\d{_FR_NUMBER}{_FR_WAYS}")
_NEAR_ES = re.compile(_ES_WAYS)
_NEAR_DE = re.compile(rf"{_DE_BEFORE} [{_UP}]")
_NUMBER_AFTER = re.compile(r" \d")
_NEAR_JA = re.compile(r"丁目|[一-鿿ァ-ヶ]\d{1,2}-\d")


def _countries(t: str) -> list[int]:
    """Which of the address patterns can match at all."""
    out = []
    if _NEAR_EN.search(t):
        out.append(0)
    if _NEAR_DE.search(t) or any(t.endswith(_DE_WAYS, 0, m.start()) for m in _NUMBER_AFTER.finditer(t)):
        out.append(1)
    if _NEAR_FR.search(t):
        out.append(2)
    if _NEAR_ES.search(t):
        out.append(3)
    if not t.isascii():
        out += [k for k, words in ((4, ("号",)), (6, ("मकान",)), (7, ("شارع", "طريق", "زقاق", "درب", "نهج")), (8, ("ถนน", "ซอย", "ตรอก"))) if any(w in t for w in words)]
        if _NEAR_JA.search(t):
            out.append(5)
    return out


_HAN_LEAD = re.compile(r"^(?:现住址?|現住所|住址|地址|家住|住在|我住|居住|位于|住所は?|自宅は?|住まいは|在|住)+")


def _addresses(t: str, taken: list[tuple[int, int, str]], out: list[tuple[int, int, str]]) -> None:
    for m in (m for k in _countries(t) for m in _ADDRESSES[k].finditer(t)):
        a, b = m.span()
        lead = _HAN_LEAD.match(m[0])
        if lead:
            a += lead.end()
        if any(a < y and x < b for x, y, _ in taken):
            continue
        if _NOT_NEAR.search(t[max(0, a - 14) : a]):
            continue
        if t[b - 1] == "." and not t.startswith((".", ",", ";"), b) and a > 1 and t[a - 1] == " " and t[a - 2].islower() and not any(y == a - 1 for _, y, _ in taken):
            b -= 1  # in running text the only full stop is the sentence's
        taken.append((a, b, "address"))
        out.append((a, b, "address"))


# ---------------------------------------------------------------- names

_PARTICLE = r"(?:van der|van den|van|von der|von|de la|de los|de|del|della|di|da|dos|du|la|le|zu|ter|VAN DER|VAN DEN|VAN|VON|DE LA|DE|DEL|DI|DA|DU)"
_TOKEN = rf"[{_UP}](?:[\w'’]*[\w])?(?:-[{_UP}][\w'’]*)*"
_INITIAL = rf"[{_UP}]\."
#: Two words or more with capitals, initials and particles between them.
_SEQUENCE = re.compile(rf"(?<![\w@./])(?:{_TOKEN}|{_INITIAL})(?: (?:{_PARTICLE} )?(?:{_INITIAL}(?= )|{_TOKEN}(?![\w@])))+")
#: Family, Given wherever it stands.
_COMMA = re.compile(rf"(?<![\w@./'’-])(?:{_PARTICLE} )?{_TOKEN}, {_TOKEN}(?: {_INITIAL}(?!\w))?(?![\w@])")
#: Stands in place of each character of a confirmed span, so that a name's context can ask for one.
_MASK = "\x01"
#: Words that begin the next field of a contact line.
_FIELD = r"(?:E-?[Mm]ail|E-MAIL|EMAIL|Mail|MAIL|T[eé]l|TEL|Telefon|Tel[eé]fono|Mobile?|M[oó]vil|Portable|Phone|PHONE|Cell|Fax|Courriel|Correo|Address|Anschrift|Adresse|Direcci[oó]n|Passport|SSN|DNI|NIF|NIE|Steuer|Nat)"
_PLAIN = rf"(?:(?:{_INITIAL}(?= )|{_TOKEN})(?: (?:{_PARTICLE} )?(?:{_INITIAL}(?= )|(?!{_FIELD}\b){_TOKEN}))+)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|M|Sr|Sra|Srta|Dra|Don|Doña|MR|MRS|MS|DR|PROF|HERR|FRAU|MME|SRA|DRA)\.?"
_NAME_LABEL = r"(?:Name|Contact|Kontakt|Contacto|Nom|Nombre|Ansprechpartner(?:in)?|References?|Candidate|Applicant|姓名|名前|氏名|नाम|الاسم|ชื่อ|联系人)"
_LABEL_BEFORE = r"(?:[^\W\d_][^\W\d_-]{0,9}\.? ?[:–]? ?)?"
#: Contexts that teach names: a label; a line of name, firm and a confirmed span; a name beside a confirmed span; a title
#: before two words. They are found in masked texts.
_SEEDS = (
    ("label", ":", re.compile(rf"(?:^|(?<=\s)){_NAME_LABEL}\s?: ({_PLAIN})(?=$|,| \||  |\n)")),
    ("line", _MASK, re.compile(rf"^({_PLAIN}), {_TOKEN}[\w&.' -]{{0,40}}, {_LABEL_BEFORE}(?={_MASK})")),
    ("bar", _MASK, re.compile(rf"^({_PLAIN}) \| {_LABEL_BEFORE}(?={_MASK})")),
    ("title", "", re.compile(rf"\b{_TITLE} ({_PLAIN})(?=$|[ ,.;)])")),
)
#: Labels in Han that a blank may part from a name before them.
_HAN_LABEL = r"(?:电话|手机|電話|携帯|邮箱|电子邮件|身份证|护照|住址|地址|现住|住所|現住所|個人番号|旅券)"
_CASELESS = {
    "han": rf"[一-鿿々]{{2,8}}(?: (?!{_HAN_LABEL})[一-鿿々]{{2,4}})?",
    "hindi": r"[ऀ-ॿ]+ [ऀ-ॿ]+",
    "arabic": r"[؀-ۿ]+ (?:ال)?[؀-ۿ]+",
    "thai": r"[฀-๿]{2,12} [฀-๿]{3,16}?",
}
_ANY = "|".join(f"(?:{p})" for p in _CASELESS.values())
_CONTACT_LABEL = r"(?:E-?mail|Mail|Email|E-MAIL|Tel|T:|Phone|Mobil|Cell|电话|手机|電話|携帯|邮箱|电子邮件|メール|住址|地址|住所|現住所|ईमेल|फ़ोन|मोबाइल|पता|هاتف|جوال|البريد|العنوان|โทร|อีเมล|ที่อยู่)"
#: Contexts that show a name in scripts without capitals; group 1 is the name.
_NAMED = (
    re.compile(rf"(?:^|(?<=\s)){_NAME_LABEL}\s?: ?({_ANY})(?=$|,| \||  |\n| [A-Za-z]|\s?\(| [+(]?\d| (?:电话|手机|電話|携帯|邮箱|メール|ईमेल|फ़ोन|हाتف|هاتف|البريد|โทร|อีเมล))"),
    re.compile(rf"(?:^|(?<=[\n,;] )|(?<=\n))({_ANY}), [{_UP}][\w&.' -]{{0,40}}, (?=[+(\d\w])"),
    re.compile(rf"^({_ANY}) (?=\| ?(?:{_CONTACT_LABEL}|[+(\d]|[\w.+-]+ ?[@(\[]))"),
    re.compile(rf"^({_ANY}) (?={_CONTACT_LABEL})"),
    re.compile(r"(?:联系|联络|上级是|经理是|主管是|同事是|上司是|是由)([一-鿿]{2,4}?)(?=[，。,、（(；]|和|先生|女士|$)"),
    re.compile(r"(?:^|[。！？；\s|:：)）、,.”」])([一-鿿]{3,4})(?=和我一起|和我?$|与我一起|先生|女士|同学|老师|[,，]电话)"),
    re.compile(r"(?:上司は|ご連絡は|担当は|同僚の|責任者は|部長の)([一-鿿々ァ-ヶ]{2,8}(?: [一-鿿々ァ-ヶ]{2,4})?)(?=でした|です|\(|さん|様|氏|まで|で?し?$)"),
    re.compile(r"(?:^|[。！？；\s|:：)、])([一-鿿々]{2,5}(?: [一-鿿々]{2,4}|[一-鿿々]{0,3}))(?=さん|様[はがをにと]|氏[はがをにと])"),
    re.compile(r"(?:कृपया|प्रमुख|श्री|श्रीमती|सुश्री|प्रबंधक|साथी|सहकर्मी) (?!(?:की|के|का|को|ने|से|में|है|हैं|थे|पर|और) )([ऀ-ॿ]+ [ऀ-ॿ]+)(?=$| (?:को|थे|थीं|हैं|से|ने|जी|का|की|के))"),
    re.compile(r"(?:^|[।?!] )([ऀ-ॿ]+ [ऀ-ॿ]+)(?= को [+\d]| थे।(?:$| ))"),
    re.compile(r"(?:مديري|مديرتي|الاتصال مع|التواصل مع|الاتصال ب|السيد|السيدة|الأستاذ|الأستاذة|الزميل|الزميلة) ([؀-ۿ]+ (?:ال)?[؀-ۿ]+)(?=[ .،,؟]|$)"),
    re.compile(r"(?:คือคุณ|คุณ|นาย|นาง|นางสาว)([฀-๿]{2,12} [฀-๿]{3,16}?)(?=ซึ่ง|เป็น|ที่|ได้|และ|จะ|ครับ|ค่ะ|$|[ ,.])"),
)
_CASELESS_CHAR = re.compile(r"[一-鿿ऀ-ॿ؀-ۿ฀-๿]")
#: The cue patterns of each script that may occur in a text.
_OWN = ((re.compile(r"[一-鿿]"), _NAMED[4:8]), (re.compile(r"[ऀ-ॿ]"), _NAMED[8:10]), (re.compile(r"[؀-ۿ]"), _NAMED[10:11]), (re.compile(r"[฀-๿]"), _NAMED[11:]))
_WHOLE = re.compile(rf"^\s?({_ANY})$")
_PAIR = "|".join(_CASELESS[k] for k in ("hindi", "arabic"))
_FIRST = re.compile(rf"^({_PAIR})(?=[ .،,।])")
_LAST = re.compile(rf"(?:^|(?<=[\s:(]))({_PAIR})[.،,।]?$")
_FIRST_HAN = re.compile(r"^([一-鿿々]{3,8})(?=[,，。、(（でさはがを])")
_LAST_HAN = re.compile(r"(?<=[。！？；,，、：:\s])([一-鿿々]{3,8})$")
#: Chinese family names of two characters, and common ones of one.
_FAMILY2 = "欧阳 上官 司马 诸葛 夏侯 慕容 令狐 钟离 闻人 东方 皇甫 尉迟 公孙 轩辕 宇文 长孙 司徒 司空 端木 百里 南宫 独孤".split()
_FAMILY1 = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"


def _han_name(s: str) -> bool:
    return len(s) in (3, 4) and s[:2] in _FAMILY2 or len(s) in (2, 3) and s[0] in _FAMILY1


_TITLES = frozenset("mr mrs ms miss dr prof herr herrn frau mme mlle m sr sra srta dra don doña d dª".split())


def _name_tokens(name: str) -> tuple[list[str], list[str]]:
    """(given, family) names of a name as written, casefolded."""
    while name.split(" ", 1)[0].rstrip(".").casefold() in _TITLES and " " in name:
        name = name.split(" ", 1)[1]
    if "," in name:
        family, given = (x.strip() for x in name.split(",", 1))
        return [x for x in given.casefold().replace("-", " ").split() if not x.endswith(".")], [_bare(family)]
    words = name.split()
    titles = [i for i, w in enumerate(words) if w.casefold() in _TITLES and len(w) > 1]
    words = words[: titles[0]] if titles else words
    at = len(words) - 1
    while at > 1 and words[at - 1].casefold() in _PARTICLES:
        at -= 1
    given = [x for w in words[:at] for x in w.casefold().split("-") if not x.endswith(".")]
    return given, [_bare(" ".join(words[at:]))]


_PARTICLES = frozenset("van der den von de la los del della di da dos du le zu ter".split())


def _bare(family: str) -> str:
    return " ".join(w for w in family.casefold().split() if w not in _PARTICLES)


# ---------------------------------------------------------------- the scan


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, bool]], list[tuple[str, str]]]:
    """(spans, possible names, seeds) of a text. Spans are (start, end, kind), 0-based, end exclusive; possible names
    (start, end, does it stand as an item in a string of items?); seeds (kind of context, name)."""
    t = text if text.isascii() else text.translate(_WIDE)
    taken: list[tuple[int, int, str]] = []
    out: list[tuple[int, int, str]] = []
    if _MAYBE_EMAIL.search(t):
        for m in _EMAIL.finditer(t):
            taken.append((*m.span(), "email"))
            out.append((*m.span(), "email"))
    if _DIGIT.search(t):
        _addresses(t, taken, out)
        _numbers(t, taken, out)
    maybe: list[tuple[int, int, bool]] = []
    seeds: list[tuple[str, str]] = []
    if _CAPITAL.search(t):
        # names don't overlap what was found so far
        masked = _masked(t, taken)
        listed = _MASK not in masked and len(_DELIMITER.findall(masked)) > 1
        turned = [(x, m.end(), False) for m in _COMMA.finditer(masked) if (x := _inverted(masked, m.start())) is not None] if ", " in masked else []
        begun = {x for x, _, _ in turned}
        for m in _SEQUENCE.finditer(masked):
            if not (m.start() in begun and m[0][:2] in ("D.", "M.")):
                maybe.append((*m.span(), listed and _is_item(masked, *m.span())))
        maybe += turned
        for kind, sign, p in _SEEDS:
            if sign in masked:
                seeds.extend((kind, m[1]) for m in p.finditer(masked))
    if _CASELESS_CHAR.search(t):
        signs = (":" in t, ", " in t, "|" in t, True)
        own = [p for script, ps in _OWN if script.search(t) for p in ps]
        for p in (*(p for p, sign in zip(_NAMED, signs, strict=False) if sign), *own):
            for m in p.finditer(t):
                a, b = m.span(1)
                if any(a < y and x < b for x, y, _ in taken):
                    continue
                if not _HAN.match(m[1]) or p is _NAMED[0] or _KANA_CUE.search(p.pattern) or _han_name(m[1]) or " " in m[1] or len(m[1]) >= 4:
                    taken.append((a, b, "name"))
                    out.append((a, b, "name"))
                    seeds.append(("label" if p is _NAMED[0] else "cue", t[a:b]))
                else:
                    # a family name that the list lacks: looked up among those that labels taught
                    maybe.append((a, b, False))
        # a name may be the whole text, or stand where a line that was wrapped around it begins or ends
        edges = {m.span(1) for p in (_WHOLE, _FIRST, _LAST, _FIRST_HAN, _LAST_HAN) for m in (p.search(t),) if m}
        maybe += [(a, b, False) for a, b in edges if not any(a < y and x < b for x, y, _ in taken)]
    return out, maybe, seeds


_DELIMITER = re.compile(r"[,;|/、，；·•]")


def _masked(t: str, taken: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, _ in sorted(taken):
        if a >= at:
            parts += [t[at:a], _MASK * (b - a)]
            at = b
    return "".join([*parts, t[at:]]) if parts else t


def _is_item(t: str, a: int, b: int) -> bool:
    """Does t[a:b] stand between delimiters or at a line's edge, as items of a string do?"""
    before, after = t[max(0, a - 3) : a].rstrip(" "), t[b : b + 2].lstrip(" ")
    sides = [not before or before[-1] in ",;|/、，；·•", not after or after[0] in ",;|/、，；·•"]
    return all(sides)


def _inverted(t: str, at: int) -> int | None:
    """Where a name begins if that at `at` may be a family name that a comma and a given name follow: not behind a
    capitalised word, which would be its given name or the rest of a firm's, unless that is a title. A D. or M. before
    it, which may be a title, is taken along."""
    if at < 2 or t[at - 1] != " ":
        return at
    start = max(t.rfind(" ", 0, at - 1), t.rfind("\n", 0, at - 1)) + 1
    word = t[start : at - 1]
    if word in ("D.", "M."):
        return start if _inverted(t, start) == start else None
    if not word[:1].isupper() or word.rstrip(".").casefold() in _TITLES:
        return at
    return at if word[-1] in ".:!?)|" and not re.fullmatch(_INITIAL, word) else None


_DIGIT = re.compile(r"\d")
_CAPITAL = re.compile(rf"[{_UP}]")
_HAN = re.compile(r"[一-鿿]")
_KANA_CUE = re.compile("さん|上司は")

_SCAN = "src string, row_key string, what string, start int, end int, value string"


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["src", "row_key", "what", "start", "end", "value"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for src, key, text in zip(b.column("src").to_pylist(), b.column("row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
            spans, maybe, seeds = find(text)
            rows = [(k, x, y, None) for x, y, k in spans]
            rows += [("?item" if item else "?", x, y, text[x:y]) for x, y, item in maybe]
            rows += [(f"seed:{kind}", 0, 0, s) for kind, s in seeds]
            for k, x, y, v in rows:
                for c, z in zip(cols, (src, key, k, x, y, v), strict=True):
                    c.append(z)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


_LEX = "token string, role string, context string, n long"


def _lexicon_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for v, context, n in zip(b["value"], b["what"], b["n"], strict=True):
            out += [(token, role, context, n) for token, role in name_roles(v)]
        yield pd.DataFrame(out, columns=["token", "role", "context", "n"])


def name_roles(v: str) -> list[tuple[str, str]]:
    """The given and family names of a name, with their roles."""
    if _HAN.match(v) and " " not in v:
        if not 2 <= len(v) <= 4:
            return []
        k = 2 if v[:2] in _FAMILY2 or len(v) == 4 else 1
        return [(v[:k], "family"), (v[k:], "given")]
    if _HAN.match(v):
        family, given = v.split(" ", 1)
        return [(family, "family"), (given, "given")]
    given, family = _name_tokens(v)
    return [(g, "given") for g in given if len(g) > 1 and g not in _PARTICLES] + [(f, "family") for f in family if len(f) > 1]


def candidate_tokens(value: str) -> list[str]:
    """What of a possible name is looked up: its words without particles and initials; parts of unspaced names."""
    if _HAN.match(value) and " " not in value:
        return [value[:k] for k in range(1, min(5, len(value)))] + [value[k:] for k in range(1, min(5, len(value)))]
    words = value.replace(",", " ").casefold().split()
    out = [w.rstrip(".") for w in words if w not in _PARTICLES and len(w.rstrip(".")) > 1]
    out += [p for w in out for p in w.split("-") if "-" in w and len(p) > 1]
    return list(dict.fromkeys(out))


def resolve(value: str, given: set[str], family: set[str]) -> list[tuple[int, int]]:
    """The names within a possible name, as offsets: given names or initials and then a family name, or a family name,
    a comma and given names."""
    if _HAN.match(value):
        if " " in value:
            a, b = value.split(" ", 1)
            return [(0, len(value))] if a in family and b in given else []
        return [(0, len(value))] if any(value[:k] in family and value[k:] in given for k in range(1, len(value))) else []
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\s,]+", value)]
    comma = value.find(",")

    def is_given(w: str) -> bool:
        parts = w.casefold().split("-")
        return all(p in given for p in parts)

    def is_initial(w: str) -> bool:
        return len(w) == 2 and w[1] == "."

    if comma > 0 and words[0][0] in ("D.", "M.") and len(words) > 1:
        # a title and an inverted name, or an initial and a family name that a comma follows
        at = words[1][1]
        turned = resolve(value[at:], given, family)
        return [(at + x, at + y) for x, y in turned] or resolve(value[:comma], given, family)
    out, i, n = [], 0, len(words)
    while i < n:
        w = words[i][0]
        if w in ("D.", "M.") and i + 1 < n and (is_given(words[i + 1][0]) or is_initial(words[i + 1][0])):
            i += 1  # Don or Monsieur, no initial
            continue
        if not (is_given(w) or is_initial(w)):
            if comma > 0:
                # Family, Given
                j = i
                while j < n and words[j][0].casefold() in _PARTICLES:
                    j += 1
                if j + 1 < n and words[j][2] == comma and words[j][0].casefold() in family and is_given(words[j + 1][0]):
                    k = j + 1
                    while k + 1 < n and (is_given(words[k + 1][0]) or is_initial(words[k + 1][0])):
                        k += 1
                    out.append((words[i][1], words[k][2]))
                    i = k + 1
                    continue
            i += 1
            continue
        j = i
        while j < n and (is_given(words[j][0]) or is_initial(words[j][0])) and (comma < 0 or words[j][2] < comma):
            j += 1
        k = j
        while k < n and words[k][0].casefold() in _PARTICLES:
            k += 1
        if k < n and words[k][0].casefold() in family and not (comma >= 0 and words[k][1] > comma):
            out.append((words[i][1], words[k][2]))
            i = k + 1
        elif j - i >= 2 and words[j - 1][0].casefold() in family:
            out.append((words[i][1], words[j - 1][2]))
            i = j
        else:
            i += 1
    return out


_RESOLVED = "value string, offsets array<struct<a:int,b:int>>"


def _resolver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for v, g, f in zip(b["value"], b["given"], b["family"], strict=True):
            found = resolve(v, set(g), set(f))
            if found:
                rows.append((v, [{"a": x, "b": y} for x, y in found]))
        yield pd.DataFrame(rows, columns=["value", "offsets"])


def personal_spans(texts: DataFrame, src: str = "src", row_key: str = "row_key", text: str = "text") -> DataFrame:
    """src, row_key, start_char, end_char (1-based, inclusive), pii_kind of every piece of personal information.

    pii_kind is email, phone, id_number, address or name. Null and empty texts and null keys give nothing; a repeated row
    counts once; an empty table gives an empty result. Texts are read whole, whatever their length. Spans of one text
    don't overlap, but for a name that was found inside an address or the like and is left out there.
    """
    rows = texts.select(F.col(src).cast("string").alias("src"), F.col(row_key).cast("string").alias("row_key"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("src is not null and row_key is not null and text <> ''")
    scan = checkpointed(rows.mapInArrow(_scanner, _SCAN))
    sure = scan.filter("what not like '?%' and what not like 'seed:%'").select("src", "row_key", "start", "end", F.col("what").alias("pii_kind"))
    seeds = scan.filter("what like 'seed:%'").groupBy("value", "what").agg(F.count("*").alias("n"))
    taught = seeds.mapInPandas(_lexicon_rows, _LEX).groupBy("token", "role").agg(F.sum("n").alias("support"), F.countDistinct("context").alias("contexts"))
    maybe = scan.filter("what like '?%'").select("src", "row_key", "start", "end", "value", "what")
    # distinct strings are looked up, not their occurrences
    tokens = F.pandas_udf(lambda vs: vs.map(candidate_tokens), "array<string>")
    strings = maybe.groupBy("value").agg(F.count_if(F.col("what") == "?item").alias("items")).withColumn("token", F.explode(tokens("value")))
    strings = checkpointed(strings)
    items = strings.filter("items > 0").groupBy("token").agg(F.sum("items").alias("items"))
    # a word that more often stands in strings of items than in contexts of names is no name
    lexicon = taught.join(items, "token", "left").filter(F.coalesce("items", F.lit(0)) <= F.col("support") * F.col("contexts") * F.col("contexts")).select("token", "role")
    known = strings.select("value", "token").join(lexicon, "token").groupBy("value").agg(
        F.collect_set(F.when(F.col("role") == "given", F.col("token"))).alias("given"), F.collect_set(F.when(F.col("role") == "family", F.col("token"))).alias("family")
    )
    names = bounded_broadcast(checkpointed(known.filter(F.size("family") > 0).mapInPandas(_resolver, _RESOLVED)))
    found = maybe.join(names, "value").select("src", "row_key", F.col("start").alias("at"), F.explode("offsets").alias("o"))
    found = found.select("src", "row_key", (F.col("at") + F.col("o.a")).alias("start"), (F.col("at") + F.col("o.b")).alias("end"), F.lit("name").alias("pii_kind"))
    out = sure.unionByName(found).select("src", "row_key", (F.col("start") + 1).cast("int").alias("start_char"), F.col("end").cast("int").alias("end_char"), "pii_kind")
    return out.distinct()


_PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def _replacer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in batches:
        yield pd.Series([redact(t, [] if s is None else [(x["start_char"], x["end_char"], x["pii_kind"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with a placeholder in place of each span (1-based, inclusive); of overlapping spans the first stays."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a - 1 >= at:
            out += [text[at : a - 1], _PLACEHOLDER[kind]]
            at = b
    return "".join([*out, text[at:]])


def redacted(texts: DataFrame, src: str = "src", row_key: str = "row_key", text: str = "text") -> DataFrame:
    """src, row_key, text with placeholders, items (how many). Each row once; null texts stay null with 0 items."""
    spans = personal_spans(texts, src, row_key, text).groupBy("src", "row_key").agg(F.collect_list(F.struct("start_char", "end_char", "pii_kind")).alias("spans"))
    rows = texts.select(F.col(src).cast("string").alias("src"), F.col(row_key).cast("string").alias("row_key"), F.col(text).cast("string").alias("text")).dropDuplicates(["src", "row_key"])
    put = F.pandas_udf(_replacer, "string")
    joined = rows.join(spans, ["src", "row_key"], "left")
    return joined.select("src", "row_key", F.when(F.col("spans").isNull(), F.col("text")).otherwise(put("text", "spans")).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("items"))
