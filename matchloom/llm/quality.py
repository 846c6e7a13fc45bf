"""Per-document text statistics that tell natural prose from lists, tables and junk.

A text is cut into segments: lines that are wrapped prose are joined, rows of one table, items of one list and copies of
one line stand together. Counts name what is plain: item marks, equal fields in equal order, markup, encodings,
repetition. For every other segment, the distribution of its characters over classes and that of its words over
function words and others are compared with language and structure profiles by Jensen-Shannon divergence, and the
nearest profile names its kind, in any script; under 40 characters, which are no distribution, counts decide unless the
marks of a scan are scattered in them. A document is of a kind if more than two thirds of its non-blank characters are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.sentences import ITEM

#: Common function words of each language.
FUNCTION_WORDS = {
    "en": "the a an of to in and is was were for with on that by it as at be from or this which are we i you my had have has not but our will would be can all who".split(),
    "de": "der die das und in den von zu mit ist des sich auf für nicht ein eine dem als auch im wir ich sie es war hat oder aus bei wurde nach um am zum zur über".split(),
    "fr": "le la les de des du et en un une est pour que qui dans par sur au aux avec ce il elle nous vous je pas plus puis ou son sa ses se été chez d l".split(),
    "es": "el la los las de del y en un una es para que por con se su al lo como más pero fue nos no me te mi este esta entre o sus".split(),
    "hi": "है में के की का को से और ने पर था थे हैं यह कि तक एक भी हो मैंने हमारे आप".split(),
    "ar": "في من على إلى عن أن مع هذا التي كان ثم أجل بين لا ما هل قال".split(),
}
#: The languages of profiles; the last stands for scripts without spaces.
LANGUAGES = (*FUNCTION_WORDS, "caseless")
#: Each function word with its languages and what it counts for each.
_FUNCTION: dict[str, tuple[tuple[int, float], ...]] = {
    w: tuple((k, 1 / sum(w in ws for ws in FUNCTION_WORDS.values())) for k, ws in enumerate(FUNCTION_WORDS.values()) if w in ws) for w in {w for ws in FUNCTION_WORDS.values() for w in ws}
}
#: Marks and endings that prose in scripts without spaces uses all the time.
_CASELESS_FUNCTION = regex.compile(r"[的了是在和与我您从到]|[はがをにでとのもし]|です|ます|ました|การ|และ|ใน|ที่|ของ|จาก|คน|ได้|มี|ให้|เป็น|ว่า|กับ|ไม่|จะ|แล้ว|โดย|อยู่|ต้อง|เพื่อ|ความ|แต่|ซึ่ง|หรือ")

_LETTER_CLASSES = {**{c: 0 for c in "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ"}, **{c: 1 for c in "bcdfghjklmnpqrstvwxzçñß"}}
CLASSES = ("vowel", "consonant", "cluster", "other_letter", "digit", "sentence_mark", "delimiter", "symbol")
#: Means over the paragraphs of a hundred documents of each kind: shares of CLASSES, then those of each language's function
#: words among the words of its prose, or of all function words in structures. Entries are the lines of a post held or of
#: contacts: neither prose nor items.
_LATIN = (0.364, 0.513, 0.022, 0.002, 0.046, 0.026, 0.020, 0.007)
_INDIC, _INDIC_ONLY = (0.053, 0.084, 0.007, 0.751, 0.058, 0.032, 0.007, 0.008), (0.004, 0.006, 0.003, 0.942, 0.012, 0.025, 0.006, 0.002)
PROFILES = {
    "prose_en": (_LATIN, {"en": 0.34, "de": 0.007, "es": 0.005}),
    "prose_de": (_LATIN, {"de": 0.31, "en": 0.01, "fr": 0.005}),
    "prose_fr": (_LATIN, {"fr": 0.24, "es": 0.06, "en": 0.02}),
    "prose_es": (_LATIN, {"es": 0.28, "fr": 0.07, "en": 0.03}),
    "prose_han": ((0.084, 0.139, 0.014, 0.576, 0.083, 0.054, 0.034, 0.016), {"caseless": 0.21}),
    "prose_kana": ((0.063, 0.105, 0.011, 0.667, 0.075, 0.048, 0.019, 0.012), {"caseless": 0.43}),
    "prose_thai": ((0.035, 0.058, 0.004, 0.829, 0.059, 0.010, 0.003, 0.002), {"caseless": 0.12}),
    "prose_hi": (_INDIC, {"hi": 0.25}),
    "prose_ar": (_INDIC, {"ar": 0.20}),
    "prose_han_only": ((0.004, 0.006, 0.004, 0.890, 0.020, 0.050, 0.024, 0.002), {"caseless": 0.21}),
    "prose_kana_only": ((0.004, 0.006, 0.006, 0.912, 0.020, 0.040, 0.010, 0.002), {"caseless": 0.43}),
    "prose_thai_only": ((0.004, 0.006, 0.003, 0.970, 0.012, 0.002, 0.001, 0.002), {"caseless": 0.12}),
    "prose_hi_only": (_INDIC_ONLY, {"hi": 0.24}),
    "prose_ar_only": (_INDIC_ONLY, {"ar": 0.18}),
    "list_latin": ((0.309, 0.515, 0.047, 0.000, 0.012, 0.011, 0.096, 0.011), 0.03),
    "list_native": ((0.100, 0.160, 0.015, 0.560, 0.030, 0.020, 0.100, 0.015), 0.03),
    "list_native_only": ((0.004, 0.006, 0.005, 0.874, 0.010, 0.002, 0.097, 0.002), 0.02),
    "table_latin": ((0.220, 0.335, 0.021, 0.023, 0.246, 0.003, 0.088, 0.064), 0.03),
    "table_native": ((0.085, 0.138, 0.011, 0.356, 0.234, 0.003, 0.101, 0.072), 0.05),
    "entry_latin": ((0.270, 0.403, 0.024, 0.000, 0.167, 0.051, 0.064, 0.020), 0.04),
    "entry_native": ((0.130, 0.207, 0.018, 0.361, 0.167, 0.028, 0.060, 0.029), 0.02),
    "junk_letters": ((0.210, 0.370, 0.390, 0.000, 0.005, 0.012, 0.012, 0.001), 0.005),
    "junk_marks": ((0.120, 0.160, 0.160, 0.030, 0.080, 0.100, 0.060, 0.290), 0.005),
    "junk_scan": ((0.110, 0.314, 0.018, 0.000, 0.058, 0.111, 0.220, 0.170), 0.069),
    "junk_codes": ((0.140, 0.200, 0.260, 0.020, 0.280, 0.000, 0.020, 0.080), 0.0),
    "junk_native": ((0.003, 0.004, 0.110, 0.868, 0.003, 0.006, 0.003, 0.003), 0.0),
    "junk_kana": ((0.003, 0.004, 0.080, 0.898, 0.003, 0.006, 0.003, 0.003), 0.10),
    "junk_rare": ((0.003, 0.004, 0.730, 0.248, 0.003, 0.006, 0.003, 0.003), 0.0),
    "junk_filling": ((0.003, 0.004, 0.008, 0.970, 0.003, 0.006, 0.003, 0.003), 0.0),
}
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzçñß]{3,}")
#: What words of other scripts hardly hold: signs without their letter, small kana alone, Arabic letters that never
#: meet or end a word within it. Han characters outside the first levels of GB 2312 and JIS X 0208 are rare.
_UNLIKELY = tuple(
    (re.compile(own), re.compile(odd))
    for own, odd in (
        (r"[ऀ-ॿ]", r"(?<![\u0915-\u0939\u0958-\u095f\u093c])[\u093c\u093e-\u094d]|(?<![\u0905-\u0939\u0958-\u0961\u093c\u093e-\u094c])[\u0901-\u0903]"),
        (r"[฀-๿]", r"(?<![\u0e01-\u0e2e\u0e31\u0e32\u0e34-\u0e3a\u0e47-\u0e4d])[\u0e30-\u0e3a\u0e47-\u0e4e]|[\u0e40-\u0e44](?![\u0e01-\u0e2e])|[\u0e31\u0e34-\u0e39]{2}|[\u0e48-\u0e4b]{2}"),
        (r"[぀-ヿ]", r"(?<![きしちにひみりぎじぢびぴ])[ゃゅょ]|(?<![キシチニヒミリギジヂビピテデフヴ])[ャュョ]|[っッ](?![か-とぱ-ぽば-ぼさ-ぞカ-トパ-ポバ-ボサ-ゾ])|(?<![ァ-ヴー])[ーァィゥェォ]|[ぁぃぅぇぉゎヮ]|(?<![ぁ-ん一-鿿])ん"),
        (r"[؀-ۿ]", r"[ةى](?=[ء-ي])|[حخعغ]{2}|[قك]{2}|[ثذزظضش][ثذزسصظض]|([ء-ي])\1\1|ء(?=[ء-غ])"),
    )
)
#: The first levels: rows 16 to 55 and 16 to 47.
_COMMON_HAN = frozenset("".join(bytes((a, b)).decode(code, "ignore") for code, last in (("gb2312", 0xD7), ("euc_jp", 0xCF)) for a in range(0xB0, last + 1) for b in range(0xA1, 0xFF)))
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_'’-]+")
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&[a-zA-Z]{2,8};|&#\d+;")
_CODE = re.compile(r"(?<![^\s])(?=[A-Za-z0-9+/=_-]*[a-z])(?=[A-Za-z0-9+/=_-]*[A-Z])(?=[A-Za-z0-9+/=_-]*\d)[A-Za-z0-9+/=_-]{28,}(?![^\s])")
_HEX = re.compile(r"^[0-9a-f]{8}:?(?: [0-9a-f]{2,4}){4,}|^(?:[0-9a-fA-F]{2}[ :]){8,}")
_MOJIBAKE = re.compile(r"[ÃÂâ][\x80-\xbf€™œžŸ¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾]|[\u0080-\u009f�]|[¢¤¥¦¨©ª¬®¯±²³´µ¶¸¹¼½¾]")
_SENTENCE_END = re.compile(r"[.!?。！？।؟…][\"'”’»)\]」』]*$")
_NUMBER = re.compile(r"\d[\d.,:/-]*$")
_STRING = re.compile(r"\s*[,;|/、，；／·]\s+|\s*[;、；]\s*")
_SEPARATOR = re.compile(r"[,;|/、，；／·]")
_ALNUM = re.compile(r"[^\W_]")
_ODD = re.compile(r"[\x80-\xbfÃÂâ€™œžŸ�]")
_GAPS = re.compile(r" {2,}")
_HAN = re.compile(r"[一-鿿]")
_OTHER_SCRIPT = re.compile(r"[\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_SCATTER = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~"
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")


#: Classes of the characters met so far (as many as Unicode has at most), 8 for blanks.
_KNOWN_CLASSES = dict(_LETTER_CLASSES)


def class_counts(text: str) -> list[int]:
    """Characters of each of CLASSES; blanks don't count."""
    out = [0] * 8
    if text.isascii():
        kinds = text.encode().translate(_ASCII_CLASSES)
        out = [kinds.count(k) for k in range(8)]
        runs = _CLUSTER.findall(text)
        out[2] = sum(map(len, runs)) - 2 * len(runs)
        out[1] -= out[2]
        return out
    for ch, n in Counter(text).items():
        kind = _KNOWN_CLASSES.get(ch)
        if kind is None:
            kind = _KNOWN_CLASSES[ch] = 8 if ch.isspace() else _other_class(ch)
        if kind < 8:
            out[kind] += n
    # the third and later of a run of consonants
    out[2] = sum(len(m[0]) - 2 for m in _CLUSTER.finditer(text))
    out[1] -= out[2]
    if _OTHER_SCRIPT.search(text):
        odd = sum(len(odd.findall(text)) for own, odd in _UNLIKELY if own.search(text)) + sum(ch not in _COMMON_HAN for ch in _HAN.findall(text))
        odd = min(odd, out[3])
        out[2] += odd
        out[3] -= odd
    return out


def _other_class(ch: str) -> int:
    if ch.isalpha() or ord(ch) > 0x900 and regex.match(r"\p{M}", ch):
        return 3
    if ch.isdigit():
        return 4
    if ch in ".!?。！？।؟…":
        return 5
    return 6 if ch in ",;:|/、，；：()+" else 7


#: The class of each ASCII character, 8 for blanks.
_ASCII_CLASSES = bytes(_LETTER_CLASSES.get(chr(k), 8 if chr(k).isspace() else _other_class(chr(k))) for k in range(128)) + bytes(128)


def divergence(p: tuple[float, ...] | list[float], q: tuple[float, ...] | list[float]) -> float:
    """Jensen-Shannon divergence of two distributions, base 2."""
    out = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        if a > 0:
            out += a * math.log2(a / m) / 2
        if b > 0:
            out += b * math.log2(b / m) / 2
    return max(out, 0.0)


def function_languages(text: str) -> tuple[list[float], int]:
    """(share of each of LANGUAGES' function words among the words, words). A word of several languages counts for each in
    part; in scripts without spaces, marks and endings per three characters."""
    out = [0.0] * len(LANGUAGES)
    if text.isascii():
        # words between blanks: letters among marks are none
        words = [w.strip(".,;:!?()\"'") for w in text.casefold().split()]
    else:
        words = _WORD.findall(text.casefold())
        caseless = len(_CASELESS.findall(text)) if _OTHER_SCRIPT.search(text) else 0
        if caseless * 4 > len(text):
            out[-1] = min(1.0, len(_CASELESS_FUNCTION.findall(text)) * 1.5 / caseless)
            return out, max(1, caseless // 3)
    for w in filter(_FUNCTION.__contains__, words):
        for k, part in _FUNCTION[w]:
            out[k] += part
    n = max(1, len(words))
    return [x / n for x in out], len(words)


def function_share(text: str) -> tuple[float, int]:
    """(share of function words of any language, words)."""
    shares, words = function_languages(text)
    return min(1.0, sum(shares)), words


def _entropy_terms(shares: np.ndarray) -> np.ndarray:
    """x log2 x of each share, 0 for 0."""
    return shares * np.log2(shares + 1e-300)


#: PROFILES as rows: shares of CLASSES; shares of function words of LANGUAGES and of other words. Lists, tables, entries
#: and junk have no language: theirs are as many function words, of whatever languages a text has.
_NAMES, _C, _L = tuple(PROFILES), len(CLASSES), len(LANGUAGES)
_NO_LANGUAGE = np.array([not isinstance(f, dict) for _, f in PROFILES.values()])
_FEW = np.array([f for _, f in PROFILES.values() if not isinstance(f, dict)])
_ROWS = np.array([[x / sum(q) for x in q] + ([f.get(k, 0.0) for k in LANGUAGES] + [1 - sum(f.values())] if isinstance(f, dict) else [0.0] * _L + [1 - f]) for q, f in PROFILES.values()])
#: Half the sum of x log2 x of each row, without the part that depends on a text's languages.
_TERMS = _entropy_terms(_ROWS).sum(axis=1) / 2
_TERMS[_NO_LANGUAGE] += _entropy_terms(_FEW) / 2


def nearest_profile(text: str, shares: list[float] | None = None) -> tuple[str, float]:
    """The nearest of PROFILES and the sum of both Jensen-Shannon divergences: of the characters' classes, and of the
    words over each language's function words and others.

    Each divergence is the entropy of the mean of both distributions less the mean of their entropies."""
    counts = class_counts(text.casefold())
    own = function_languages(text)[0] if shares is None else shares
    total, n = sum(own), sum(counts) or 1
    mix = [x / total for x in own] if total else [1 / _L] * _L
    total = min(total, 1.0)
    x = np.array([*(c / n for c in counts), *(m * total for m in mix), 1 - total])
    rows = _ROWS.copy()
    rows[_NO_LANGUAGE, _C : _C + _L] = _FEW[:, None] * mix
    d = _TERMS - _entropy_terms((rows + x) / 2).sum(axis=1)
    d[_NO_LANGUAGE] += _FEW * (sum(m * math.log2(m) for m in mix if m) / 2)
    k = int(d.argmin())
    return _NAMES[k], max(float(d[k] + _entropy_terms(x).sum() / 2), 0.0)


def _blank_free(text: str) -> int:
    return len("".join(text.split()))


def _fields(line: str) -> tuple[str, list[str]]:
    """(delimiter, fields) of a line that may be a table's row; '' if it is none."""
    for d in ("\t", "│", "|", ";", ","):
        if line.count(d) >= 2:
            return d, [x.strip() for x in line.strip().strip("|│" if d in "|│" else "\0").split(d)]
    parts = _GAPS.split(line.strip())
    return ("  ", parts) if len(parts) >= 3 else ("", [])


def _is_table(rows: list[tuple[str, list[str]]]) -> bool:
    """Do these rows have the same fields in the same order?"""
    d = rows[0][0]
    widths = Counter(len(f) for _, f in rows)
    width, n = widths.most_common(1)[0]
    body = [f for _, f in rows if len(f) == width]
    if d == "  ":
        # empty fields leave no trace here: any row of three fields or more, most with numbers
        return len(rows) >= 2 and sum(any(_NUMBER.match(x) for x in f) for _, f in rows) >= 0.6 * len(rows)
    if n < 0.8 * len(rows) or width < 3:
        return False
    if d == "|" and any(all(set(x) <= set("-: ") and x for x in f) for f in body):
        return True
    typed = [sum(bool(_NUMBER.match(f[c])) for f in body) for c in range(width)]
    return max(typed) >= 0.6 * n


def _is_string(line: str) -> bool:
    """Is the line a string of short items?"""
    if not _SEPARATOR.search(line):
        return False
    items = [x for x in _STRING.split(line) if x]
    if len(items) < 2 or _SENTENCE_END.search(line) and not line.endswith((".js", ".NET")):
        return False
    longest = max(len(x.split()) for x in items)
    return longest <= 3 and (len(items) >= 3 or len(line) < 60)


def _junk(line: str) -> bool:
    words = line.split()
    n = sum(map(len, words))
    if not _ALNUM.search(line):
        return n >= 4
    if len(words) > 4 and _HEX.match(line):
        return True
    if max(map(len, words)) >= 28 and sum(len(m[0]) for m in _CODE.finditer(line)) > 0.5 * n:
        return True
    if len(words) >= 5 and len(set(words)) <= 0.25 * len(words):
        return True  # one word over and over
    if "<" in line or "&" in line:
        if sum(len(m[0].replace(" ", "")) for m in _MARKUP.finditer(line)) > 0.5 * n:
            return True
    if _ODD.search(line):
        return 2.5 * len(_MOJIBAKE.findall(line)) > n
    return False


def kinds(text: str) -> dict[str, int]:
    """Non-blank characters by kind: prose, list, table, junk, other (headings, contact lines, single short lines)."""
    out = {"prose": 0, "list": 0, "table": 0, "junk": 0, "other": 0}
    lines = [x for x in text.split("\n")]
    copies = Counter(x for x in lines if len(x) > 8)
    para: list[str] = []
    for line in [*lines, ""]:
        if line and not line.isspace():
            para.append(line)
        elif para:
            _paragraph(para, copies, out)
            para = []
    return out


def _paragraph(lines: list[str], copies: Counter, out: dict[str, int]) -> None:
    kind: list[str | None] = []
    for line in lines:
        if copies[line] >= 4 or _junk(line):
            kind.append("junk")
        elif ITEM.match(line):
            kind.append("list")
        else:
            kind.append(None)
    # rows of tables: series of lines with one delimiter
    i, n = 0, len(lines)
    while i < n:
        if kind[i] == "junk" or i + 1 == n or kind[i + 1] == "junk" and "|" not in lines[i]:
            i += 1  # a table has two rows or more
            continue
        d, f = _fields(lines[i])
        if not d or kind[i] == "list" and d not in "|│\t":
            i += 1
            continue
        rows, j = [(d, f)], i + 1
        while j < n:
            # the delimiter of the first row holds for all
            if kind[j] == "junk" and d != "|":
                break
            if d == "  ":
                dj, fj = "  ", _GAPS.split(lines[j].strip())
                if len(fj) < 3:
                    break
            elif lines[j].count(d) >= 2:
                dj, fj = d, [x.strip() for x in lines[j].strip().strip("|│" if d in "|│" else "\0").split(d)]
            else:
                break
            rows.append((dj, fj))
            j += 1
        if len(rows) >= 2 and _is_table(rows):
            kind[i:j] = ["table"] * (j - i)
        i = max(j, i + 1) if kind[i] == "table" else i + 1
    # what is left: wrapped running text, strings of items, bare items, single lines
    i = 0
    while i < n:
        if kind[i] is not None:
            i += 1
            continue
        j = i
        while j < n and kind[j] is None:
            j += 1
        _plain(lines[i:j], kind, i)
        i = j
    for line, k in zip(lines, kind, strict=True):
        out[k or "other"] += _blank_free(line)


def _wrapped(lines: list[str]) -> bool:
    """Are the line breaks those of wrapped text: would each next word have been too long for its line?"""
    if len(lines) < 2:
        return False
    width = max(len(x) for x in lines)
    full = sum(len(a) + 1 + len(b.split(None, 1)[0] if not _CASELESS.match(b) else b[0]) >= width - 1 for a, b in zip(lines, lines[1:], strict=False))
    return full >= 0.75 * (len(lines) - 1)


def _plain(lines: list[str], kind: list[str | None], at: int) -> None:
    strings = [_is_string(x) for x in lines]
    if sum(strings) == len(lines):
        kind[at : at + len(lines)] = ["list" if len(lines) > 1 or len(_STRING.split(lines[0])) >= 4 else "other"] * len(lines)
        return
    joined = " ".join(lines)
    marks = sum(bool(_SENTENCE_END.search(x)) for x in lines)
    shares, words = function_languages(joined)
    share = sum(shares)
    short = sum(len(x) <= 45 for x in lines)
    wrapped = _wrapped(lines)
    if len(lines) >= 4 and short >= 0.85 * len(lines) and not wrapped and marks <= 0.1 * len(lines):
        # bare items, one in each line
        kind[at : at + len(lines)] = ["list"] * len(lines)
        return
    # too few characters are no distribution, unless marks stand among them
    if len(joined) >= 40 or len(joined) >= 20 and joined.isascii() and 4 * sum(map(joined.count, _SCATTER)) > _blank_free(joined):
        name = nearest_profile(joined, shares)[0].split("_")[0]
        if len(joined) >= 40 or name == "junk":
            kind[at : at + len(lines)] = ["other" if name == "entry" else name] * len(lines)
            return
    if wrapped or marks or len(lines) < 4 and words > 12 or share >= 0.2 and words > 12:
        for x in range(len(lines)):
            kind[at + x] = "list" if strings[x] and not wrapped and not marks else "prose" if len(joined) >= 30 else "other"
        return
    for x in range(len(lines)):
        kind[at + x] = "list" if strings[x] else "other"


def document_kind(counts: dict[str, int]) -> str:
    """prose, list, table or junk if more than two thirds of the non-blank characters are of it, else mixed."""
    total = sum(counts.values())
    for k in ("list", "table", "junk", "prose"):
        if 3 * counts[k] > 2 * total:
            return k
    return "mixed"


STATS = (
    "chars int, words int, mean_word_length double, symbol_ratio double, digit_ratio double, upper_ratio double, lines int, lines_with_end_mark double, lines_with_item_mark double, "
    "function_words double, distinct_words double, profile string, divergence double, prose_share double, list_share double, table_share double, junk_share double, doc_kind string"
)
#: The general category of each character met so far: S for symbols, N for digits, U and L for letters, M for marks, a
#: blank for white space.
_CATEGORIES: dict[str, str] = {}


def _category(ch: str) -> str:
    kind = _CATEGORIES.get(ch)
    if kind is None:
        c = unicodedata.category(ch)
        kind = _CATEGORIES[ch] = " " if ch.isspace() else "U" if c == "Lu" else c[0] if c[0] in "LMN" else "S"
    return kind


def statistics(text: str | None) -> dict:
    text = text or ""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    words = _WORD.findall(text)
    full = _blank_free(text)
    counts = kinds(text)
    total = sum(counts.values()) or 1
    shares, _ = function_languages(text)
    share = min(1.0, sum(shares))
    name, d = nearest_profile(text, shares) if full else ("empty", 0.0)
    chars = dict.fromkeys("SNULM ", 0)
    for ch, n in Counter(text).items():
        chars[_category(ch)] += n
    return {
        "chars": full, "words": len(words), "mean_word_length": sum(map(len, words)) / max(1, len(words)), "symbol_ratio": chars["S"] / max(1, full),
        "digit_ratio": chars["N"] / max(1, full), "upper_ratio": chars["U"] / max(1, chars["U"] + chars["L"]), "lines": len(lines),
        "lines_with_end_mark": sum(bool(_SENTENCE_END.search(x.rstrip())) for x in lines) / max(1, len(lines)), "lines_with_item_mark": sum(bool(ITEM.match(x)) for x in lines) / max(1, len(lines)),
        "function_words": share, "distinct_words": len(set(words)) / max(1, len(words)), "profile": name, "divergence": d,
        **{f"{k}_share": counts[k] / total for k in ("prose", "list", "table", "junk")}, "doc_kind": document_kind(counts) if full else "junk",
    }


def text_statistics(text: Column | str) -> Column:
    """A struct of STATS for every text. A null or blank text has 0 everywhere, the profile 'empty' and the kind 'junk'.

    Ratios are of non-blank characters, of letters for upper_ratio, of non-blank lines for lines_with. Texts of any
    length are read whole.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=names)

    return F.pandas_udf(run, STATS)(text)


def kind_of(text: Column | str) -> Column:
    """The document's kind alone: prose, list, table, junk or mixed; null for a null or blank text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([document_kind(kinds(t)) if t and not t.isspace() else None for t in texts], dtype=object)

    # not deterministic for the optimizer, else a filter on the kind would compute it a second time below
    return F.pandas_udf(run, "string").asNondeterministic()(text)


def with_statistics(df: DataFrame, item: str, text: str) -> DataFrame:
    """item and STATS, one row for each row of df; an empty table gives an empty result."""
    return df.select(F.col(item), text_statistics(F.col(text)).alias("__s")).select(item, "__s.*")
