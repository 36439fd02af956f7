"""Garbled text from wrong character encoding: round-trip repair under a garbling cost.

A word is re-encoded under a legacy encoding and strictly decoded as the encoding that may have
been meant; the result stands when its cost drops, and the trip repeats for nested layers. The
cost of a text is how rare its pairs of neighbouring characters are in the whole corpus: a pair
model counted over all documents, in which scripts with large alphabets are single classes, so
that its size is bounded whatever the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings a text may wrongly have been decoded with. cp1252+ gives undefined bytes their control characters.
WRONG = ("cp1252+", "latin-1", "mac_roman", "cp437", "cp850", "cp866", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "koi8-r", "cp932", "gbk")
#: Encodings that may have been meant.
MEANT = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "euc_jp", "cp932", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2")
#: Upper- and lower-cased copies of UTF-8 text that was decoded wrongly: the case is undone before the trip.
CASED = ("cp1252+ upper", "cp1252+ lower", "cp1251 upper", "cp1250 upper", "mac_roman upper", "mac_roman lower")
WRONG += CASED
MEANT_FOR = {w: ("utf-8",) if w in CASED else ("utf-8", "euc_jp", "cp932") if w in ("cp932", "gbk") else MEANT for w in WRONG}
#: A document is garbled when its words' cost falls by so much in all under one pair of encodings.
LEAST_DROP = 6.0
#: Under an encoding that accepts any bytes, the drop must be so great and two different words must take part, or one whose
#: repaired pairs of characters beyond ASCII each occur at least COMMON times in the corpus.
LEAST_DROP_LAX, COMMON = 12.0, 20
STRICT = frozenset(("utf-8", "euc_jp", "cp932"))
#: A word must gain at least so much, and so much per pair of characters.
WORD_DROP, PAIR_DROP = 2.0, 0.0

#: Bytes of other text hardly ever read as kana, so a result that holds some may cost this much more per pair.
_KANA, KANA_SLACK = re.compile("[\u3041-\u3096\u30a1-\u30fa]{2}"), 1.0
#: Control characters and private or unassigned ones, which no repaired text holds.
_NO_TEXT = re.compile("[\x80-\x9f\ue000-\uf8ff\ufffd]")
_SPLIT = re.compile(r"[ \t\r\n\f\v]+")
#: What a member of a class costs beyond its class: the logarithm of how many are in common use.
MEMBER = {"一": 7.5, "あ": 3.5, "ア": 4.0, "한": 6.5, "ก": 3.5, "ا": 3.0, "א": 3.0, "अ": 3.5, "、": 1.0, "Ａ": 4.0}
#: Classes of what is left, by general category; private characters stand for them.
_OTHER = {k: chr(0xE000 + ord(k)) for k in "LMNSPC"}
MEMBER |= {_OTHER[k]: 7.0 for k in _OTHER}
_BULK = {"CJK": "一", "HIRAGANA": "あ", "KATAKANA": "ア", "HANGUL": "한", "THAI": "ก", "ARABIC": "ا", "HEBREW": "א", "DEVANAGARI": "अ"}


@lru_cache(maxsize=1 << 16)
def char_class(c: str) -> str:
    """Latin, Greek and Cyrillic letters and signs as they are; other scripts, digits and spaces by class."""
    o = ord(c)
    if o < 128:
        return "0" if c.isdigit() else " " if c.isspace() else c
    if o < 0xA0:
        return c
    if c.isspace() and c != "\xa0":
        return " "
    if 0x3000 <= o <= 0x303F:
        return "、"
    if 0xFF00 <= o <= 0xFFEF:
        return "ア" if 0xFF65 <= o <= 0xFF9F else "Ａ"
    if o < 0x530 or 0x2000 <= o < 0x2600:
        return c
    name = unicodedata.name(c, "")
    for word, representative in _BULK.items():
        if name.startswith(word):
            return representative
    return _OTHER.get(unicodedata.category(c)[0], _OTHER["C"])


def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of classes with at least one character beyond ASCII, counted per batch."""
    for pdf in batches:
        n: Counter[str] = Counter()
        for text in pdf["text"]:
            for word in _SPLIT.split(text):
                if not word.isascii():
                    w = " " + "".join(map(char_class, word)) + " "
                    n.update(w[i : i + 2] for i in range(len(w) - 1))
        yield pd.DataFrame(list(n.items()), columns=["pair", "n"]).astype({"n": "int64"})


def pair_model(documents: DataFrame) -> dict[str, int]:
    """Pair counts over all documents; at most the square of some 2,900 classes, whatever the corpus.

    Pairs with a character beyond ASCII only; the bound is 8.4 million rows of some 20 bytes.
    """
    rows = documents.where("text is not null").select("text").mapInPandas(count_pairs, "pair string, n long")
    return {r["pair"]: r["n"] for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


class Repairer:
    def __init__(self, pairs: dict[str, int]) -> None:
        total = sum(pairs.values()) + 1
        self.cost_of = {p: -math.log((n + 0.05) / total) for p, n in pairs.items()}
        self.unseen = -math.log(0.05 / total)
        self.common = {p for p, n in pairs.items() if n >= COMMON}
        self.memo: dict[str, dict] = {}

    def cost(self, word: str) -> tuple[float, float]:
        """How implausible the word's characters beyond ASCII are among their neighbours: in all and per pair."""
        w = " " + "".join(map(char_class, word)) + " "
        get, unseen = self.cost_of.get, self.unseen
        out, n = 0.0, 0
        for i in range(len(w) - 1):
            if w[i] > "\x7f" or w[i + 1] > "\x7f":
                out += get(w[i : i + 2], unseen)
                n += 1
        for c in w:
            if c > "\x7f":
                out += MEMBER.get(c, 8.0 if c < "\xa0" or c == "\ufffd" else 0.0)
        return out, out / n if n else 0.0

    def usual(self, word: str) -> bool:
        """Whether every pair of characters with one beyond ASCII is common in the corpus."""
        w = " " + "".join(map(char_class, word)) + " "
        return all(w[i : i + 2] in self.common for i in range(len(w) - 1) if w[i] > "\x7f" or w[i + 1] > "\x7f")

    def trips(self, word: str) -> dict[tuple[str, str], tuple[float, str]]:
        """Per pair of encodings that lowers the word's cost: the drop and the text of the round trip."""
        known = self.memo.get(word)
        if known is not None:
            return known
        (before, mean), out = self.cost(word), {}
        for wrong in WRONG:
            raw = encode(word, wrong)
            if raw is None:
                continue
            for meant in MEANT_FOR[wrong]:
                try:
                    text = raw.decode(meant)
                except UnicodeDecodeError:
                    continue
                if text == word or (meant != "utf-8" and _NO_TEXT.search(text)):
                    continue
                after, after_mean = self.cost(text)
                least = -KANA_SLACK if meant != "utf-8" and _KANA.search(text) else PAIR_DROP
                if before - after >= WORD_DROP and mean - after_mean >= least:
                    out[wrong, meant] = before - after, text
                if meant == "utf-8":
                    # layers of one encoding: a layer between may look no better than the outermost
                    # every layer undone shortens the word, so the loop ends by itself
                    for layer in count(2):
                        raw_again = encode(text, wrong)
                        try:
                            deeper = raw_again.decode(meant) if raw_again else text
                        except UnicodeDecodeError:
                            break
                        if len(deeper) >= len(text):
                            break
                        text = deeper
                        after, after_mean = self.cost(text)
                        if before - after >= WORD_DROP and mean - after_mean >= PAIR_DROP:
                            out[f"{layer}x{wrong}", meant] = before - after, text
        if len(self.memo) < 300_000:
            self.memo[word] = out
        return out

    def repair(self, text: str) -> tuple[str, list[str], float]:
        """The text after as many round trips as lower its cost; the trips taken; the whole drop."""
        taken, total = [], 0.0
        while True:  # every repair lowers the cost by LEAST_DROP at least, so it ends
            words = [w for w in _SPLIT.split(text) if not w.isascii()]
            gains: dict[tuple[str, str], float] = {}
            cores: dict[tuple[str, str], set[str]] = {}
            clear: set[tuple[str, str]] = set()
            for w in words:
                if meaningful(w):
                    for pair, (drop, repaired) in self.trips(w).items():
                        gains[pair] = gains.get(pair, 0.0) + drop
                        cores.setdefault(pair, set()).add("".join(filter(str.isalpha, w)))
                        if drop >= LEAST_DROP_LAX and not _NO_TEXT.search(w) and self.usual(repaired):
                            clear.add(pair)
                elif len(w) == 1 and w.isalpha():
                    # a word of one character is evidence beside others, never alone
                    for pair in self.trips(w):
                        cores.setdefault(pair, set()).add(w)
            gains = {p: g for p, g in gains.items() if g >= LEAST_DROP and (p[1] in STRICT or (g >= LEAST_DROP_LAX and (len(cores[p]) > 1 or p in clear)))}
            if not gains:
                break
            pair, gain = max(gains.items(), key=lambda x: (x[1], x[0]))
            swap = {w: t[pair][1] for w in set(words) if pair in (t := self.trips(w))}
            text = re.sub(r"[^ \t\r\n\f\v]+", lambda m: swap.get(m.group(), m.group()), text)
            taken.append("/".join(pair))
            total += gain
        return text, taken, total


@lru_cache(maxsize=1 << 14)
def _byte1252(c: str) -> bytes | None:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else None


def encode(word: str, encoding: str) -> bytes | None:
    if " " in encoding:
        encoding, case = encoding.split()
        turned = "".join(c if c < "\x80" else c.upper() if case == "upper" else c.lower() for c in word)
        if turned == word or len(turned) != len(word):
            return None
        word = turned
    if encoding == "cp1252+":
        parts = [_byte1252(c) for c in word]
        return None if None in parts else b"".join(parts)
    try:
        return word.encode(encoding)
    except UnicodeEncodeError:
        return None


def meaningful(word: str) -> bool:
    """Whether characters beyond ASCII, other than common punctuation, touch letters or each other."""
    if _PUNCTUATED.fullmatch(word):
        return False
    for i, c in enumerate(word):
        if c > "\x7f" and ((i and (word[i - 1].isalpha() or word[i - 1] > "\x7f")) or (i + 1 < len(word) and (word[i + 1].isalpha() or word[i + 1] > "\x7f"))):
            return True
    return False


#: Words of which only dashes, quotes, ellipses and hard spaces are beyond ASCII.
_PUNCTUATED = re.compile("[\\x00-\x7f\xa0\xab\xbb\u2010-\u2027\u2039\u203a]*")
_LOST = re.compile("[\x80-\x84\x86-\x9f]|\ufffd")


def find_garbled(documents: DataFrame) -> DataFrame:
    """Garbled documents: doc_id, trips (wrong/meant, outermost first), drop, lost, reason, repaired.

    ``reason`` is ``round trip`` for texts that a trip repairs, and ``lost`` for those that no trip
    repairs but that hold replacement or control characters, which no intended text does. ``lost`` tells that replacement or control characters remain, so that part of the original is
    gone. Null, empty and pure ASCII texts are never garbled; repeated rows give repeated results;
    whole texts are read, in parts of the text as well as in all of it. Other columns are ignored.
    """
    model = documents.sparkSession.sparkContext.broadcast(pair_model(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Repairer(model.value)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if text.isascii():
                    continue
                fixed, taken, drop = r.repair(text)
                lost = bool(_LOST.search(fixed))
                if taken or lost:
                    out.append((doc, taken, round(drop, 3), lost, "round trip" if taken else "lost", fixed))
            yield pd.DataFrame(out, columns=["doc_id", "trips", "drop", "lost", "reason", "repaired"])

    rows = documents.where("text is not null").select("doc_id", "text")
    return rows.mapInPandas(run, "doc_id long, trips array<string>, drop double, lost boolean, reason string, repaired string")
