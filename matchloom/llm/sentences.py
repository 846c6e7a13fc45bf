"""Sentence boundaries in wrapped lines, across languages and scripts.

A pushdown automaton runs over a run of lines. Its input are the few characters that matter: sentence-ending marks,
quotation marks and brackets. Its stack holds the open quotations and brackets; list items enter as units of their own
with their nesting level. An ending mark counts at the bottom of the stack only, after its closing marks, and if neither
an abbreviation (a trie over the reversed text) nor what follows speaks against it. A quotation or bracket that is never
closed is taken off the stack and the run is read again from there.

Lines reach it in order: one shuffle by document, a sort, and a streaming pass that holds one run at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, casefolded, without their last full stop, and what a full stop after them means.
#: A name, number or word always follows.
NEVER = (
    "mr mrs ms messrs z sg ee sec secs geb gest verh ggü dr drs prof st mme mlle herr fr sr sra srta dra d dª fa fam hr univ viz vs cf cfr incl inkl excl exkl fig figs eq eqs no nos nr núm num nº n.º n.ª "
    "pág págs pag p pp s abs art kap vol bd ed eds rev rel ver v ref réf tel tél telf tlf apt app ext approx aprox appr ca env e.g i.e z.b z. d.h d. c.-à-d c.à.d p.ej p. u.a.m "
    "bzw vgl evtl ggf sog zzgl gem lt gen gov sgt capt col lt hon rev sen rep mt ft bldg dept dipl dipl.-ing ing lic mag dipl.-kfm avda av bd boul str c/ sig siehe resp "
    "chap sect par al. max min avg est tech int nat adm डॉ नं श्री कु प्रो"
)
#: Company forms, degrees, places, times and lists: the sentence may end here if a sentence begins after it.
MAYBE = (
    "inc corp ltd co llc plc gmbh s.a s.l s.r.l ag jr sr. etc usw u.a al ff f a.m p.m am. pm. u.s u.k u.s.a e.u uu jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun "
    "rd ave blvd ln sq hwy ct pl ter b.sc m.sc b.a m.a ph.d m.d d.sc b.eng m.eng m.phil b.s m.s ll.b ll.m bts"
)
#: Words that begin sentences and are no names.
STARTERS = frozenset(
    "the a an i we you he she it they my our your his her its their this that these those there here in on at by from of for with after before since until when while if as then once over under most some many "
    "all each every no not nothing was were is are did do does what why how who where which and but so or to be can could would should will training candidates applicants please ask contact version between note looking "
    "der die das den dem ein eine einen einem ich wir sie er es man im am zum zur bei beim mit nach seit von vor zwischen als wenn wir ihre mein meine unser unsere gute zwingend siehe lohnt wozu warum was wie "
    "le la les l un une des du de au aux je nous vous il elle on ce cet cette ces mon notre votre en dans pour par avec sans chez entre après avant depuis quand si puis quelle quel pourquoi contact j "
    "el los las lo una unos unas yo nosotros usted ellos mi nuestro nuestra su en por para con sin entre desde hasta cuando al del se te me es qué por buscamos escribí".split()
)
#: Words with a small first letter that begin sentences: names of tools.
SMALL_STARTERS = frozenset("npm dbt pandas ios ipados macos ebay kubectl systemd nginx jquery webpack pytest numpy conda pip git curl bash vim".split())
#: Words between a clause's start and a company whose form ends in a full stop.
PREPOSITIONS = frozenset("at for with in by of bei für mit von im chez pour avec en con para por".split())
PARTICLES = frozenset("van der den de la le di da du von zu del dos y und et and".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember quartal halbjahr".split())
STREETS = frozenset("rd ave blvd ln sq hwy ct pl ter str".split())
DEGREES = frozenset("b.sc m.sc b.a m.a ph.d m.d d.sc b.eng m.eng m.phil b.s m.s ll.b ll.m dipl dipl.-ing".split())
COMPANIES = frozenset("inc corp ltd co llc plc gmbh s.a s.l s.r.l ag".split())
#: After a quotation, these words carry the sentence on: Arabic, Hindi.
ARABIC_ON = frozenset("ثم و ف وقال فقال وخرج كما".split())
#: Thai words that begin sentences.
THAI_STARTS = ("ผม", "ดิฉัน", "ฉัน", "คุณ", "เรา", "พวก", "เขา", "เธอ", "ทีม", "บริษัท", "งาน", "ต้อง", "โปรด", "กรุณา", "เวลา", "หัวหน้า", "ส่ง", "นอกจาก", "เมื่อ", "หลัง", "ก่อน", "ใน", "จาก", "เพราะ", "แต่", "และ", "ทุก", "ท่าน", "เริ่ม")

ENDS = ".!?…。！？।॥؟۔｡．‼⁇⁈⁉"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "〈": "〉", "《": "》", "｢": "｣"}
CLOSERS = "”“»」』）)]】〉》｣\"'’＂"
_EVENT = regex.compile(rf"[{regex.escape(ENDS)}]+|[\"“”„«»「」『』（）()\[\]【】〈〉《》｢｣]")
_ANY_END = regex.compile(rf"[{regex.escape(ENDS)}]|\p{{Thai}}")
_THAI = regex.compile(r"\p{Thai}")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{L}\p{N}])[ \t\n ]+(?=\p{Thai})")
_THAI_TITLE = regex.compile(r"คุณ\p{Thai}{2,14}$")
_LABEL = regex.compile(r"^[^\s:：]{1,14}(?: [^\s:：]{1,14})?\s?[:：]")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Arabic}\p{Devanagari}\p{Thai}]")
_NO_WORD = frozenset("\"“”„«»()[]（）「」『』,;:،؛、，；：|/")
_LOWER_WORD = regex.compile(r"\b\p{Ll}{2,}\b")
_NEXT_WORD = regex.compile(r"\s*([\p{L}\p{N}_+#-]+)")
#: What makes a line a list item: its marker, with the space after it.
ITEM = regex.compile(r"^[ \t　]*(?:[•●○◦▪▸►➤➢★✦✧→⮞⬥■□·‣*✓✔☐☑☒–—-]|\[[ xX]\]|\d{1,3}[.)]|\(\d{1,2}\)|[a-z][.)]|[A-Z]\)|\(?[ivx]{1,5}[.)]|\(?[IVX]{2,5}[.)])(?:[ \t　]+)(?=\S)")
#: These may also begin a wrapped line of running text; there, they mark an item only after a line that is complete.
_AMBIGUOUS = regex.compile(r"^[ \t　]*[\w(–—-]")
_SMALL_LETTER = regex.compile(r"^\s*[a-z]\.")
_COMPLETE = ENDS + CLOSERS + ":："
_PAGE = regex.compile(r"^\s*(?:page\s+\d+(?:\s+of\s+\d+)?|-\s*\d+\s*-|\d+\s*/\s*\d+|\[\s*\d+\s*\])\s*$", regex.I)


def build_trie(words: Iterable[str]) -> dict:
    """A trie over reversed words; '' marks a word's end."""
    root: dict = {}
    for w in words:
        node = root
        for ch in reversed(w):
            node = node.setdefault(ch, {})
        node[""] = w
    return root


_TRIE = build_trie([*NEVER.split(), *MAYBE.split()])
_NEVER = frozenset(NEVER.split())


def abbreviation_before(text: str, dot: int) -> str | None:
    """The longest abbreviation that ends right before the full stop at `dot` and begins at a word's start."""
    node, at, found = _TRIE, dot - 1, None
    while at >= 0:
        node = node.get(text[at].casefold())
        if node is None:
            break
        if "" in node and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == ".")):
            found = node[""]
        at -= 1
    return found


@dataclass(slots=True)
class _Quote:
    mark: str
    at: int
    bracket: bool


def _starts_sentence(text: str, at: int) -> bool | None:
    """Does a sentence begin at or after `at`? None at the end of the text. Small letters begin none, but for tools."""
    n = len(text)
    while at < n and (text[at].isspace() or text[at] == "​"):
        at += 1
    if at >= n:
        return None
    ch = text[at]
    if ch in "\"“„«「『(（[¿¡‘'‚【《〈":
        return True if ch in "¿¡" else _starts_sentence(text, at + 1)
    if ch.islower():
        m = _NEXT_WORD.match(text, at)
        word = m[1] if m else ch
        return word.casefold() in SMALL_STARTERS or any(c.isupper() for c in word[1:]) or ("-" in word and word.startswith("scikit"))
    if ch == "." and at + 1 < n and text[at + 1].isupper():
        return True  # .NET and the like
    return ch.isalnum() or ord(ch) > 0x2E80


def _word_before(text: str, begin: int, end: int) -> str:
    """The word that ends at `end`, whatever its length."""
    at = end
    while at > begin and not (text[at - 1].isspace() or text[at - 1] in _NO_WORD):
        at -= 1
    return text[at:end]


def _full_stop_ends(text: str, begin: int, dot: int, after: int) -> bool:
    """Is the single full stop at `dot` the end of the sentence that began at `begin`? after: behind its closers."""
    if dot == 0:
        return False
    prev = text[dot - 1]
    nxt = text[after] if after < len(text) else ""
    if prev.isspace() or prev in "([{/":
        return False
    word = _word_before(text, begin, dot)
    if nxt and not nxt.isspace() and after == dot + 1:
        # no space behind it: inside a number, name or address, or the space was lost
        if nxt.isdigit() or not (nxt.isupper() or nxt in "\"“«„("):
            return False
        if "@" in word or "＠" in word or "/" in word or "." in word or len(word) < 2:
            return False
        rest = _NEXT_WORD.match(text, after)
        if not (prev.islower() or prev in "%)" or prev.isdigit()) or word[:1].isupper() and len(word) < 4:
            return False
        return bool(rest) and (len(rest[1]) == 1 or any(c.islower() for c in rest[1][1:])) and not (rest[1].isupper() and len(rest[1]) > 1)
    follows = _starts_sentence(text, after)
    m = _NEXT_WORD.match(text, after)
    next_word = m[1] if m else ""
    low = next_word.casefold().split("'")[0].split("’")[0]
    script = _CASELESS.match(next_word) if next_word else None
    if script and regex.match(r"\p{Devanagari}|\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Thai}", next_word):
        return False  # scripts with an ending mark of their own, or without any
    if regex.match(r"\p{Devanagari}|\p{Thai}", prev):
        return False
    abbr = abbreviation_before(text, dot)
    if abbr is not None:
        street = abbr in STREETS and _clause(text, begin, dot)
        if abbr in _NEVER and not street:
            return False
        if abbr in DEGREES:
            return follows is None and _clause(text, begin, dot) or low in STARTERS and low == next_word.casefold().split("'")[0] and bool(follows)
        if abbr in COMPANIES or abbr == "co":
            if script:
                return False
            if follows is None:
                return _clause(text, begin, dot)
            return bool(follows) and not _opens_clause(text, begin, dot)
        if abbr in STREETS:
            return street and follows is not False
        if follows is None:
            return _clause(text, begin, dot) or dot - begin > 25
        return follows and not next_word[:1].isdigit()
    if len(word) == 1 and word.isalpha() and word.isupper() and word.isascii() or regex.fullmatch(r"(?:\p{Lu}\.-?)+\p{Lu}", word):
        # an initial, unless the next word is none that could be a name
        return follows is None and _clause(text, begin, dot) or bool(follows) and low in STARTERS and len(word) == 1
    if prev.isdigit() and low in MONTHS:
        return False
    if follows is None:
        return not (text[begin:dot].strip().isdigit())
    return bool(follows)


def _clause(text: str, begin: int, end: int) -> bool:
    """Does this read as a clause, not as a name or an address?"""
    s = text[begin:end]
    if _CASELESS.search(s):
        return True
    if not any(c.islower() for c in s):
        return len(s.split()) > 5
    return sum(w not in PARTICLES for w in _LOWER_WORD.findall(s)) >= 2


def _opens_clause(text: str, begin: int, dot: int) -> bool:
    """Does the company that ends at `dot` stand in an adverbial that opens the sentence (At Miller Inc. I built ...)?"""
    words = text[begin:dot].split()
    at = len(words) - 1
    while at >= 0 and (words[at][:1].isupper() or words[at] in ("&", "+")) and words[at].casefold() not in PREPOSITIONS:
        at -= 1
    if at < 0 or words[at].casefold() not in PREPOSITIONS:
        return False
    return at == 0 or words[at - 1][-1] in ",:;" or at <= 4 and words[at][:1].isupper()


_SAID = regex.compile(r"\s*[^।?!]{1,40}?(?:कहा|पूछा|बोले|बोला|बोली|लिखा|था|थी|थे)\s*[।?!]")


def _quote_ends(text: str, begin: int, q: _Quote, inner: str, after: int) -> bool:
    """A quotation or bracket with an ending mark inside was closed at the bottom of the stack: did the sentence end?"""
    follows = _starts_sentence(text, after)
    if follows is None:
        return True
    before = text[begin : q.at].rstrip()
    nxt = text[after] if after < len(text) else ""
    if nxt in ",;，、；،:：)":
        return False
    m = _NEXT_WORD.match(text, after)
    word = m[1] if m else ""
    if q.bracket and before:
        return False
    if word and _CASELESS.match(word):
        if regex.match(r"\p{Han}|\p{Hiragana}|\p{Katakana}", word):
            if nxt in "とのとはがをにでも的让把使" or regex.match(r"(?:って|という|と|の|は|が|を|に|で|も)", word):
                return False
            return before.endswith(("：", ":", "，", "、")) or not before
        if regex.match(r"\p{Devanagari}", word):
            # a few words up to the mark, with a verb of saying, belong to the quotation
            return _SAID.match(text, after) is None
        if word in ARABIC_ON or before and not before.endswith((":", "：", ".")):
            return False
        return True
    if not follows:
        return False
    if before and word.isupper() and word.casefold() in PARTICLES:
        return False
    return True


def ends_of(text: str) -> list[int]:
    """The index of the last character of every full sentence of a run, ascending. Lines are separated by newlines."""
    out: list[int] = []
    ignored: set[int] = set()
    at, n = 0, len(text)
    begin = 0
    stack: list[_Quote] = []
    pending = -1  # behind the last ending mark inside the open quotation, if nothing but closers followed
    events = list(_EVENT.finditer(text))
    i = 0
    while True:
        if i >= len(events):
            if stack:
                # none of these is ever closed: what is matched depends on the top of the stack alone, so without the
                # lowest the others would be left over again; read on from the lowest without any of them
                lost = stack[0].at
                ignored.update(q.at for q in stack)
                while i and events[i - 1].start() >= lost:
                    i -= 1
                stack = []
                continue
            break
        e = events[i]
        i += 1
        s, t = e.span()
        ch = e[0]
        if s in ignored or s < at:
            continue
        if ch[0] in ENDS:
            if stack:
                pending = t
                continue
            stop, close = t, t
            # closing marks, with the space that French puts before a guillemet
            while close < n and (text[close] in ")]”»」』）】’'" or text[close] == '"' and not _opens(text, close)):
                close += 1
            if len(ch) == 1 and ch in ".．" and not _full_stop_ends(text, begin, s, close):
                continue
            if len(ch) > 1 or ch == "…":
                follows = _starts_sentence(text, close)
                if set(ch) <= set(".…"):
                    m = _NEXT_WORD.match(text, close)
                    if follows is False or (m and _CASELESS.match(m[1])):
                        continue
            elif ch in "!?":
                follows = _starts_sentence(text, close)
                if follows is False and close < n and not text[close].isspace():
                    continue  # inside an address or a name
            if not any(c.isalnum() for c in text[begin:stop]):
                continue
            out.append(close - 1)
            begin = at = close
            continue
        if stack and (ch in PAIRS.get(stack[-1].mark, "") or ch == '"' == stack[-1].mark):
            q = stack.pop()
            if stack:
                continue
            inner = text[q.at + 1 : s].rstrip()
            close = t
            if inner and inner[-1] in ENDS and pending >= 0:
                while close < n and text[close] in ")]”»」』）】":
                    close += 1
                if _inner_ends(inner) and _quote_ends(text, begin, q, inner, close):
                    out.append(close - 1)
                    begin = at = close
            pending = -1
        elif ch in PAIRS or ch == '"' and _opens(text, s):
            stack.append(_Quote(ch, s, ch in "（([【〈"))
            if len(stack) == 1:
                pending = -1
    return out


def _inner_ends(inner: str) -> bool:
    """Is the ending mark within a quotation or bracket more than an abbreviation's full stop?"""
    if inner[-1] != "." or inner.endswith(".."):
        return True
    abbr = abbreviation_before(inner, len(inner) - 1)
    return abbr is None or abbr not in _NEVER and _clause(inner, 0, len(inner))


def _opens(text: str, at: int) -> bool:
    """Does a straight quotation mark open a quotation here?"""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    return (not before or before.isspace() or before in "([（「“„«—–-") and bool(after) and not after.isspace()


def thai_ends(text: str) -> list[int]:
    """The last letters of sentences of Thai prose, which writes a space where a sentence ends (and elsewhere, too)."""
    out, begin = [], 0
    for m in _THAI_GAP.finditer(text):
        if not text.startswith(THAI_STARTS, m.end()) or not _THAI.match(text[m.start() - 1]):
            continue  # no opener, or beside a foreign word or number
        # a title and a given name of 14 letters take 17 characters
        if _THAI_TITLE.search(text, max(begin, m.start() - 17), m.start()) or not _thai_sentence(text[begin : m.start()]):
            continue  # between a given and a family name
        out.append(m.start() - 1)
        begin = m.end()
    tail = text[begin:].rstrip()
    if tail and _THAI.match(tail[-1]) and _thai_sentence(tail):
        out.append(begin + len(tail) - 1)
    return out


def _thai_sentence(s: str) -> bool:
    letters = len(_THAI.findall(s))
    if letters < 15 or "|" in s or _LABEL.match(s):
        return False
    return letters >= 24 or any("0" <= c <= "z" and c.isalnum() for c in s)


def run_ends(lines: list[str], item: bool) -> list[tuple[int, int, int, int]]:
    """(first line, first character, last line, last character) of each full sentence of a run, 0-based, inclusive."""
    skip = 0
    if item:
        m = ITEM.match(lines[0])
        skip = m.end() if m else 0
    text = "\n".join(lines)[skip:]
    if not _ANY_END.search(text):
        return []
    ends = ends_of(text)
    if _THAI.search(text):
        ends = sorted({*ends, *thai_ends(text)})
    if not ends:
        return []
    starts_at, total = [], 0
    for line in lines:
        starts_at.append(total)
        total += len(line) + 1
    out, begin, row, first = [], 0, 0, 0
    for e in ends:
        while begin < len(text) and text[begin].isspace():
            begin += 1
        a, b = begin + skip, e + skip
        while first + 1 < len(lines) and starts_at[first + 1] <= a:
            first += 1
        row = max(row, first)
        while row + 1 < len(lines) and starts_at[row + 1] <= b:
            row += 1
        out.append((first, a - starts_at[first], row, b - starts_at[row]))
        begin = e + 1
    return out


#: A line of fields (a job, a contact, a list of skills): it stands alone and holds no running text.
_FIELDS = regex.compile(r" [|│] .* [|│] |^[^|]{0,60} [|│] [^|]{0,80}$")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[int], list[str], bool, int]]:
    """(doc, line numbers, texts, is a list item, list level) of each run of lines sorted by doc, line, heading first."""
    doc, last, nos, texts = object(), -1, [], []
    levels: list[int] = []
    heading_at = -1
    for b in batches:
        docs, lines, heads, values = (b.column(c).to_pylist() for c in ("__d", "__n", "__h", "__t"))
        for d, n, h, t in zip(docs, lines, heads, values, strict=True):
            if d == doc and n == last and not h:
                continue  # a repeated row
            if d != doc or n != last + 1 or h or not t or n == heading_at or t.isspace():
                if nos:
                    yield doc, nos, texts, False, len(levels)
                    nos, texts = [], []
                if d != doc:
                    levels, heading_at = [], -1
                doc, last = d, n
                if h:
                    heading_at, last = n, n - 1
                    continue
                if n == heading_at or not t or t.isspace():
                    continue
            last = n
            if ITEM.match(t) and not (nos and _AMBIGUOUS.match(t) and (texts[-1].rstrip()[-1] not in _COMPLETE or _SMALL_LETTER.match(t))):
                if nos:
                    yield doc, nos, texts, False, len(levels)
                    nos, texts = [], []
                indent = len(t) - len(t.lstrip())
                while levels and levels[-1] > indent:
                    levels.pop()
                if not levels or levels[-1] < indent:
                    levels.append(indent)
                yield doc, [n], [t], True, len(levels)
            elif _PAGE.match(t) or _FIELDS.search(t):
                if nos:
                    yield doc, nos, texts, False, 0
                    nos, texts = [], []
            else:
                if not nos:
                    levels = []
                nos.append(n)
                texts.append(t)
    if nos:
        yield doc, nos, texts, False, len(levels)


def _emit(with_text: bool, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(7 if with_text else 3)]
        names = ["__d", "start_line", "start_char", "line_no", "end_char", "list_level", "text"] if with_text else ["__d", "line_no", "end_char"]
        types = [doc_type, *([pa.int32()] * (5 if with_text else 2)), *([pa.string()] * with_text)]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for doc, nos, texts, item, level in _runs(batches):
            for a, ac, b, bc in run_ends(texts, item):
                if with_text:
                    parts = [texts[i][ac if i == a else 0 : bc + 1 if i == b else None].strip() for i in range(a, b + 1)]
                    for c, v in zip(cols, (doc, nos[a], ac + 1, nos[b], bc + 1, level if item else 0, join_lines(parts)), strict=True):
                        c.append(v)
                else:
                    cols[0].append(doc)
                    cols[1].append(nos[b])
                    cols[2].append(bc + 1)
            if len(cols[0]) > 20_000:
                yield batch()
                cols = [[] for _ in cols]
        yield batch()

    return run


def join_lines(parts: list[str]) -> str:
    """Lines joined with a blank, but with nothing between characters of scripts without spaces."""
    out = parts[0]
    for p in parts[1:]:
        glue = "" if out and p and _NO_SPACE.match(out[-1]) and _NO_SPACE.match(p[0]) else " "
        out += glue + p
    return out


_NO_SPACE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-･]")


def _ordered(lines: DataFrame, doc: str, line_no: str, text: str, headings: DataFrame | None, heading_doc: str, heading_line: str) -> DataFrame:
    rows = lines.select(F.col(doc).alias("__d"), F.col(line_no).cast("int").alias("__n"), F.col(text).cast("string").alias("__t"), F.lit(False).alias("__h"))
    if headings is not None:
        heads = headings.select(F.col(heading_doc).alias("__d"), F.col(heading_line).cast("int").alias("__n"), F.lit(None).cast("string").alias("__t"), F.lit(True).alias("__h"))
        rows = rows.unionByName(heads)
    rows = rows.filter("__d is not null and __n is not null")
    # a repeated line with and without its text counts with it, so nulls sort last
    return rows.repartition("__d").sortWithinPartitions("__d", "__n", F.desc("__h"), F.col("__t").desc_nulls_last())


def sentence_ends(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", text: str = "text", headings: DataFrame | None = None, heading_doc: str = "doc_id", heading_line: str = "line_no") -> DataFrame:
    """doc, line_no, end_char (1-based, inclusive) of the last character of every full sentence.

    A run is a series of lines with consecutive numbers that are neither empty nor headings, list items, page marks or
    lines of fields; a list item is a run of its own. A missing line number ends a run like an empty line. Repeated
    lines count once, null and empty texts are empty lines, rows with a null document or number are left out. Sentences
    without an ending mark give no row, except in Thai, which writes none. Empty tables give an empty result; lines and
    documents may be of any length. Memory holds one run.
    """
    rows = _ordered(lines, doc, line_no, text, headings, heading_doc, heading_line)
    field = rows.schema["__d"]
    kind = field.dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    return rows.mapInArrow(_emit(False, arrow), f"__d {kind}, line_no int, end_char int").withColumnRenamed("__d", doc)


def sentences(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", text: str = "text", headings: DataFrame | None = None, heading_doc: str = "doc_id", heading_line: str = "line_no") -> DataFrame:
    """The sentences themselves: doc, start_line, start_char, line_no, end_char, list_level (0: running text), text.
    The same rules as sentence_ends."""
    rows = _ordered(lines, doc, line_no, text, headings, heading_doc, heading_line)
    kind = rows.schema["__d"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    schema = f"__d {kind}, start_line int, start_char int, line_no int, end_char int, list_level int, text string"
    return rows.mapInArrow(_emit(True, arrow), schema).withColumnRenamed("__d", doc)
