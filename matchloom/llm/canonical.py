"""Freely written values mapped to a canonical list.

Values are deduplicated twice, as written and as normalised, so each distinct spelling is scored once. Both sides are
cut into character n-grams; an inverted index from n-gram to list entries retrieves the candidates, whose weighted
cosine is then added up. Where lists are long, only the rarest n-grams of either side generate candidates, which loses
none that reaches the threshold. The best candidate is accepted above a threshold and with a margin over the next;
between the two thresholds an edit distance that knows abbreviations and misread characters decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import bounded_broadcast, checkpointed

#: Texts whose candidates one task looks up and compares.
TEXTS_PER_TASK = 2000

#: Traditional characters that are written otherwise in simplified Chinese (those common in headings).
_SIMPLIFIED = str.maketrans("專業經歷個簡職責務學術證書聯絡繫語獎項興趣參與實習團隊領導計劃開發員電腦軟體軟資訊檔案總結簡單優勢國際報導關於們條", "专业经历个简职责务学术证书联络系语奖项兴趣参与实习团队领导计划开发员电脑软体软资讯档案总结简单优势国际报导关于们条")
#: Characters that scanning or haste puts for letters.
_MISREAD = str.maketrans({"0": "o", "1": "i", "5": "s", "3": "e", "4": "a", "8": "b", "|": "l", "$": "s", "@": "a"})
#: Pairs of letters that are misread for each other; a swap within a pair costs less.
_LOOKALIKE = {frozenset(p) for p in ("ce", "co", "oe", "il", "ij", "lt", "ft", "uv", "vy", "nh", "hb", "mn", "rn", "gq", "sz", "ao", "ea", "kh", "pf", "mr", "ou")}
_LEAD = regex.compile(r"^(?:[\s#=*•■□◆▪►>~_|·—–\-]+|[【\[(（「『《]+|(?:\d{1,3}|[IVXivx]{1,5}|[A-Za-z])[.)、．]\s*(?=\S)|[一二三四五六七八九十]{1,3}、\s*)+")
_TAIL = regex.compile(r"(?:[\s#=*:：;,.·…_~|<>—–\-!]+|[】\])）」』》]+|[(（]\s*\d+\s*(?:/\s*\d+\s*)?[)）])+$")
_FORMAT = regex.compile(r"\p{Cf}|\p{Cc}")
_SPACED = regex.compile(r"^(?:\S\p{M}*(?:\s+|$)){4,}$")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_WORD = regex.compile(r"([\p{L}\p{M}\p{N}|$]+)(\.?)")
#: Remarks after a heading that are no part of it.
_REMARK = regex.compile(r"(?i)(?<=\S)(?:\s*[(（\[]\s*(?:cont(?:inued|d)?|suite|forts(?:etzung)?|fortgesetzt)\.?\s*[)）\]]|\s+cont(?:inued|d)?\.?|\s+overview|\s*(?:&|and|\+)\s*more)[\s:：.*=_\-–—]*$")
_INNER = regex.compile(r"(?<=\p{L}{2})['’](?=\p{L}{2})")

def _repaired(s: str) -> str:
    """Text whose UTF-8 bytes were read as a one-byte encoding, read rightly; other text unchanged."""
    if "Ã" in s or "Â" in s or "à¤" in s:
        for encoding in ("cp1252", "latin-1"):
            try:
                return s.encode(encoding).decode("utf-8")
            except UnicodeError:
                pass
    return s


def normalise(value: str) -> str:
    """Small letters and digits, words apart by one blank, a full stop kept behind an abbreviated word; without
    numbering, decoration, spacing, page counts and remarks such as (cont.)."""
    s = unicodedata.normalize("NFKC", _FORMAT.sub("", _repaired(value))).strip().replace("_", " ")
    dotted = ""
    s = _INNER.sub("", s)
    for _ in range(4):
        t = _REMARK.sub("", _LEAD.sub("", s))
        m = _TAIL.search(t)
        if m:
            dotted = "." if m[0].startswith(".") and not m[0].startswith("..") else ""
            t = t[: m.start()]
        if t == s or not t.strip():
            break
        s = t
    s += dotted
    wide = [w for w in re.split(r"\s{2,}", s) if w]
    if _SPACED.match(s + " ") and len(s.split()) >= 4 or len(wide) > 1 and all(_SPACED.match(w + " ") or len(w) == 1 for w in wide):
        s = " ".join(re.sub(r"\s", "", w) for w in wide)
    if s.count(",") == 1:
        a, b = s.split(",")
        s = f"{b} {a}"
    s = unicodedata.normalize("NFC", s.casefold()).translate(_SIMPLIFIED)
    words = []
    for m in _WORD.finditer(s):
        w, dot = m[1], m[2]
        if any(c.isalpha() for c in w) and any(c.isdigit() for c in w):
            w = w.translate(_MISREAD)
        words.append(w + dot)
    out = " ".join(words)
    if _CASELESS.search(out) and not regex.search(r"[a-z]{2}", out):
        out = out.replace(" ", "")
    return out


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> float:
    """Edits from a to b, swapped neighbours counting one and lookalikes half."""
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    before, now = [0.0] * (m + 1), [float(j) for j in range(m + 1)]
    for i in range(1, n + 1):
        last, before, now = before, now, [float(i)] + [0.0] * m
        x = a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            cost = 0.0 if x == y else 0.5 if frozenset((x, y)) in _LOOKALIKE or _same_letter(x, y) else 1.0
            best = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, last[j - 2] + 1)
            now[j] = best
    return now[m]


@lru_cache(maxsize=4096)
def _same_letter(x: str, y: str) -> bool:
    """The same letter but for its accents?"""
    return unicodedata.normalize("NFD", x)[0] == unicodedata.normalize("NFD", y)[0]


def _contracted(word: str, target: str) -> bool:
    """Is the word the target with letters left out inside?"""
    if len(word) < 4 or len(word) * 2 < len(target) or len(word) >= len(target) or word[0] != target[0] or word[-1] != target[-1]:
        return False
    rest = iter(target)
    return all(c in rest for c in word)


def _word_fit(word: str, target: str, abbreviated: bool) -> float:
    """0..1: how well a word spells another."""
    if word == target:
        return 1.0
    if len(word) >= 3 and len(word) < len(target) and (abbreviated or len(word) <= 6 and len(target) >= 1.5 * len(word)):
        # an abbreviation: the beginning of the word
        d = distance(word, target[: len(word)])
        if d <= 0.5 * (len(word) > 4):
            return 0.9 if abbreviated else 0.8
    if 5 <= len(word) < len(target) and word[-1] == "s" == target[-1] and target.startswith(word[:-1]):
        return 0.8  # the beginning and the plural's end
    fit = max(0.0, 1 - distance(word, target) / max(len(word), len(target)))
    return max(fit, 0.78) if _contracted(word, target) else fit


_EXTRA = frozenset("my our your mein meine unser unsere mon mes notre nos mi mis nuestro nuestra".split())


def best_assignment(gain: list[list[float]]) -> list[int]:
    """The column of each row, each column once, with the greatest sum of gains: shortest augmenting paths, for any size."""
    n = len(gain)
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)  # rows and columns count from 1
    for i in range(1, n + 1):
        owner[0], col = i, 0
        low, back, done = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[col]:
            done[col], row, step, nxt = True, owner[col], math.inf, 0
            for j in range(1, n + 1):
                if not done[j]:
                    rest = -gain[row - 1][j - 1] - u[row] - v[j]
                    if rest < low[j]:
                        low[j], back[j] = rest, col
                    if low[j] < step:
                        step, nxt = low[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    low[j] -= step
            col = nxt
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def _reading(vw: list[str], ew: list[str]) -> float:
    a, b = "".join(vw).replace(".", ""), "".join(ew)
    whole = max(0.0, 1 - distance(a, b) / max(len(a), len(b), 1))
    if len(vw) == len(ew) == 1:
        if vw[0].endswith("."):
            whole = max(whole, _word_fit(a, b, True))
        if _CASELESS.match(a) and (len(a) <= 6 and sorted(a) == sorted(b) or len(b) >= 4 and a.startswith(b) and len(a) - len(b) <= 2):
            return max(whole, 0.8)  # swapped characters, or a word for section, list or the like behind it
        return max(whole, 0.78) if _contracted(a, b) else whole
    if len(vw) != len(ew):
        return whole
    fits = [[_word_fit(w.rstrip("."), t, w.endswith(".")) for t in ew] for w in vw]
    order = best_assignment([[f * len(t) for f, t in zip(row, ew, strict=True)] for row in fits])
    total = sum(fits[i][j] * len(ew[j]) for i, j in enumerate(order))
    worst = min((fits[i][j] for i, j in enumerate(order) if len(ew[j]) > 3), default=1.0)
    # one word that is another one spoils the reading, however long the others are
    return total / len(b) if worst >= 0.5 else 0.6 * whole


@lru_cache(maxsize=200_000)
def spelling(value: str, entry: str) -> float:
    """0..1: how well a normalised value spells a normalised entry. With as many words as the entry it is read word by
    word, in any order, abbreviated words by their beginnings; else as a string of letters, for lost or added blanks."""
    ew = entry.replace(".", "").split()
    vw = value.split()
    best = _reading(vw, ew)
    short = [w for w in vw if w not in _EXTRA]
    return max(best, _reading(short, ew)) if short and len(short) < len(vw) else best


def ngrams(text: Column, n: int) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    size = F.char_length(padded) - (n - 1)
    return F.when(size >= 1, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(padded, i, n))).otherwise(F.array(padded))


def _normalised(values: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            yield pd.Series([normalise(v) for v in vs], dtype=object)

    return F.pandas_udf(run, "string")(values)


def _checked(value: Column, entry: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vs, es in batches:
            yield pd.Series([spelling(v, e) for v, e in zip(vs, es, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(value, entry)


def _grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, n: of the text's words and, for misplaced blanks, of the text without blanks."""
    t = F.regexp_replace(F.col(text), r"\.", "")
    brief = F.char_length(t) <= 6
    grams = F.concat(ngrams(t, 3), F.when(brief, ngrams(t, 2)).otherwise(F.array().cast("array<string>")), ngrams(F.regexp_replace(t, " ", ""), 2))
    return df.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def _heads(grams: DataFrame, key: str, weight: str, need: Column) -> DataFrame:
    """key, gram: the rarest n-grams of each key, until the length of what is left, each one's own weight included, falls
    below `need` (less a little, for rounding)."""
    left = Window.partitionBy(key).orderBy(F.asc("idf"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
    rest = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(left))
    return grams.withColumn("__rest", rest).filter(F.col("__rest") >= need * (1 - 1e-9)).select(key, "gram")


def map_values(values: DataFrame, value: str, entries: DataFrame, entry_id: str, entry: str, retrieve: float = 0.25, accept: float = 0.9, check: float = 0.74, margin: float = 0.03, long_list: int = 1000) -> DataFrame:
    """Every distinct value of `value` with the entry it spells: value, entry_id (null: none), cosine, spelling, score.

    Where an n-gram stands in more than `long_list` entries, only rare n-grams look candidates up; the result is the same.
    A candidate shares n-grams with the value to a weighted cosine of `retrieve` or more. A cosine of `accept` settles
    it; below, the candidate must spell the entry to `check` or more. The best must lead the next by `margin`.
    Null values are left out, values that are empty after normalisation match nothing, an entry given several times
    counts once (with its smallest id), null entries are ignored. With no entries every value comes out unmatched; with
    no values the result is empty. Equal scores are no match, for want of a margin, unless the cosine tells them apart.
    """
    raw = values.select(F.col(value).alias("__v")).filter("__v is not null").distinct()
    spelt = checkpointed(raw.withColumn("__t", _normalised(F.col("__v"))))
    texts = spelt.select("__t").filter("__t <> ''").distinct()
    # the work is in characters compared, not in bytes, so the number of tasks follows the number of texts
    tasks = max(values.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // TEXTS_PER_TASK))
    grams = _grams(texts.repartition(tasks, "__t"), "__t", "__t")
    canon = entries.filter(F.col(entry).isNotNull() & F.col(entry_id).isNotNull()).select(F.col(entry_id).alias("__id"), F.col(entry).alias("__raw"))
    canon = canon.withColumn("__e", _normalised(F.col("__raw"))).groupBy("__e").agg(F.min("__id").alias("__id"))
    canon = checkpointed(canon.filter("__e <> ''"))
    post = _grams(canon, "__e", "__e")
    total = canon.agg(F.count("*").alias("N"))
    idf = post.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("gram", F.log((F.col("N") + 1) / F.col("df")).alias("idf"))
    post = post.join(idf, "gram").select("__e", "gram", (F.col("n") * F.col("idf")).alias("we"), "idf")
    e_norm = post.groupBy("__e").agg(F.sqrt(F.sum(F.col("we") * F.col("we"))).alias("ne"))
    index = checkpointed(post.join(e_norm, "__e").select("__e", "gram", (F.col("we") / F.col("ne")).alias("we"), "idf"))
    # n-grams that no entry has take part in the value's length with the greatest weight
    rarest = total.select(F.log(F.col("N") + 1).alias("max_idf"))
    known = bounded_broadcast(index.select("gram", "idf").distinct())
    weight = F.col("n") * F.coalesce("idf", F.col("max_idf"))
    norms = grams.join(known, "gram", "left").join(F.broadcast(rarest)).groupBy("__t").agg(F.sqrt(F.sum(weight * weight)).alias("nt"))
    longest = index.groupBy("gram").count().agg(F.max("count")).first()[0] or 0
    if longest <= long_list:
        # every n-gram's list is short: one join finds the candidates and adds up their products
        dots = grams.join(bounded_broadcast(index), "gram").groupBy("__t", "__e").agg(F.sum(F.col("n") * F.col("idf") * F.col("we")).alias("dot"))
    else:
        # In one order of n-grams, the rarest first, a pair that reaches `retrieve` shares one of those after which the
        # rest of either side is still long enough. Only these generate candidates, so long lists are left alone.
        weighed = grams.join(known, "gram").select("__t", "gram", "idf", (F.col("n") * F.col("idf")).alias("w"))
        lengths = norms.select("__t", (F.lit(retrieve) * F.col("nt")).alias("need"))
        asked = _heads(weighed.join(lengths, "__t"), "__t", "w", F.col("need"))
        listed = _heads(index.withColumnRenamed("we", "w"), "__e", "w", F.lit(retrieve))
        pairs = asked.join(bounded_broadcast(listed), "gram").select("__t", "__e").distinct()
        dots = pairs.join(weighed, "__t").join(bounded_broadcast(index.select("__e", "gram", "we")), ["__e", "gram"]).groupBy("__t", "__e").agg(F.sum(F.col("w") * F.col("we")).alias("dot"))
    scored = dots.join(norms, "__t").select("__t", "__e", (F.col("dot") / F.col("nt")).alias("cosine")).filter(F.col("cosine") >= retrieve)
    scored = scored.withColumn("spelling", _checked(F.col("__t"), F.col("__e"))).withColumn("score", F.greatest("spelling", "cosine"))
    w = Window.partitionBy("__t").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("cosine", 9)), "__e")
    ranked = scored.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("next_cosine", F.lead("cosine").over(w)).filter("r = 1")
    clear = (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin) | ((F.col("score") == F.col("next")) & (F.col("cosine") - F.col("next_cosine") >= margin))
    good = (F.col("cosine") >= accept) | (F.col("spelling") >= check)
    best = ranked.join(canon, "__e").select("__t", F.when(clear & good, F.col("__id")).alias("__id"), "cosine", "spelling", "score")
    return spelt.join(best, "__t", "left").select(F.col("__v").alias(value), F.col("__id").alias(entry_id), "cosine", "spelling", "score")
