"""Evaluation texts leaking into training text, by template canonicalisation.

Numbers, units, dates and names become typed placeholders, so that a re-parameterised copy keeps
its template. Windows of template words of items and documents meet in a hash join; around the
windows that meet, the two templates are aligned. A document is reported when enough of the item's
template is covered and the fillings of the placeholders map one to one, whether they are the
item's own or others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import Scratch

#: Template words of a window. A window with fewer plain words than PLAIN stands for its words themselves.
WINDOW, PLAIN = 5, 3
#: A window of more different items than this is common to them; see ``item_windows``.
COMMON = 5
#: Item windows up to this number are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Share of an item's template that a document must cover, in order and close together.
LEAST = 1 / 3
#: Share of the covered placeholders whose fillings must map one to one.
CONSISTENT = 0.6
#: Bits of the bitmaps of plain words and of item windows that every task gets: 2 MB, whatever the items.
BITS = 1 << 24
#: Scores of the alignment: equal words, equal placeholders with other fillings, and anything else.
EQUAL, SLOT, OTHER = 2, 1, -2

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile("[\xad\u200b-\u200d\u2060\ufeff]")
#: Spans of an item that are identifiers: quoted, joined by underscores or dots, or of mixed case.
_IDENTIFIER = re.compile(r"`[^`\n]*`|\w+(?:[._]\w+)+|\w*_\w+|\b[^\W\d_]*[a-z][A-Z]\w*")
_SENTENCE = re.compile(r"(?:^|[.!?:;…\n])[\s\W]*$")
_SCALES = ("", "k", "m", "g", "t", "p", "c", "d", "n", "µ", "ki", "mi", "gi", "ti")
#: Units by rule: a scale before a base unit, and the words of time, currency and share.
UNITS = frozenset(
    [s + b for s in _SCALES for b in ("b", "bit", "byte", "bytes", "s", "m", "g", "l", "w", "v", "hz", "px")]
    + [w + e for w in ("sec", "second", "min", "minute", "hour", "day", "week", "month", "year", "euro", "dollar") for e in ("", "s")]
    + ["h", "percent", "pct", "usd", "eur", "gbp"]
)
#: The names of months and weekdays.
DATES = frozenset(
    """january february march april may june july august september october november december
    monday tuesday wednesday thursday friday saturday sunday""".split()
)
NUMBER, NAME, UNIT, DATE = "#", "@", "%", "&"
#: How a word was seen in the items: only at the start of sentences, as a name, in lower case.
_AT_START, _AS_NAME, _AS_WORD = 1, 2, 3


def words(text: str | None) -> list[str]:
    """Case-folded words; punctuation, white space, line marks and invisible characters do not count."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_HIDDEN.sub("", text).casefold())


def sightings(text: str) -> list[tuple[str, int]]:
    """Every word of an item with how it was seen: a name (capital within a sentence, identifier) or not."""
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    named = np.zeros(len(text) + 1, bool)
    for m in _IDENTIFIER.finditer(text):
        named[m.start() : m.end()] = True
    out = []
    for m in _WORD.finditer(text):
        w = m.group()
        if any(map(str.isdigit, w)):
            continue
        start = m.start()
        if named[start]:
            how = _AS_NAME
        elif w[0].isupper():
            how = _AT_START if _SENTENCE.search(text, max(0, start - 20), start) or start < 2 else _AS_NAME
        else:
            how = _AS_WORD
        out += [(v, how) for v in words(w)]
    return out


def bit_of(x: str | int) -> int:
    return (xxhash.xxh64_intdigest(x) if isinstance(x, str) else x) % BITS


def has_bits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Templates:
    """Templates and windows under a bitmap of the items' plain words; words are looked up once."""

    def __init__(self, plain: bytes) -> None:
        self.bitmap = np.frombuffer(plain, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.kinds: list[str] = []
        self.codes, self.own, self.plain = np.empty(1024, np.uint64), np.empty(1024, np.uint64), np.empty(1024, bool)

    def kind(self, w: str) -> str:
        """A placeholder's type, or the word where it is plain. A word that no item has as a plain word is a name."""
        if any(map(str.isdigit, w)):
            return NUMBER
        if w in UNITS:
            return UNIT
        if w in DATES:
            return DATE
        b = bit_of(w)
        return w if self.bitmap[b >> 3] >> (b & 7) & 1 else NAME

    def look_up(self, ws: list[str]) -> np.ndarray:
        if len(self.number) > 400_000:
            self.forget()
        number = self.number
        for w in set(ws).difference(number):
            n = number[w] = len(number)
            if n == len(self.codes):
                self.codes, self.own, self.plain = (np.concatenate((a, a)) for a in (self.codes, self.own, self.plain))
            k = self.kind(w)
            self.kinds.append(k)
            self.codes[n], self.own[n], self.plain[n] = xxhash.xxh64_intdigest(k), xxhash.xxh64_intdigest(w), k == w
        return np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))

    def windows(self, ws: list[str]) -> np.ndarray:
        """The hash of the window at every position."""
        if len(ws) < WINDOW:
            return np.empty(0, np.int64)
        at = self.look_up(ws)
        code, own, plain = self.codes[at], self.own[at], self.plain[at]
        n = len(ws) - WINDOW + 1
        enough = np.cumsum(np.concatenate(([0], plain)))
        enough = enough[WINDOW:] - enough[:-WINDOW] >= PLAIN
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = (h ^ np.where(enough, code[k : k + n], own[k : k + n])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def template(self, ws: list[str]) -> list[str]:
        at = self.look_up(ws)
        return [self.kinds[i] for i in at]


def align(item: list[str], part: list[str], item_t: list[str], part_t: list[str]) -> list[tuple[int, int]]:
    """The best local alignment of two templates as pairs of positions of equal template words."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in a], np.int32) for a in (item, part))
    xt, yt = (np.array([ids.setdefault("\0" + w, len(ids)) for w in a], np.int32) for a in (item_t, part_t))
    m = len(y)
    h = np.zeros((len(x) + 1, m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * -OTHER
    for i in range(1, len(x) + 1):
        gain = np.where(y == x[i - 1], EQUAL, np.where(yt == xt[i - 1], SLOT, OTHER))
        row = h[i, 1:]
        np.maximum(h[i - 1, :-1] + gain, h[i - 1, 1:] + OTHER, out=row)
        np.maximum(row, 0, out=row)
        # gaps along the row: the running maximum of score + position, less position
        h[i] = np.maximum(np.maximum.accumulate(h[i] + ramp) - ramp, 0)
    i, j = map(int, np.unravel_index(int(h.argmax()), h.shape))
    out = []
    while h[i, j] > 0:
        same = i and j and xt[i - 1] == yt[j - 1]
        gain = (EQUAL if x[i - 1] == y[j - 1] else SLOT) if same else OTHER
        if i and j and h[i, j] == h[i - 1, j - 1] + gain:
            i, j = i - 1, j - 1
            if same:
                out.append((i, j))
        elif i and h[i, j] == h[i - 1, j] + OTHER:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def verify(item: list[str], part: list[str], templates: Templates, least: float) -> tuple[float, float, float]:
    """Share of the item's template covered by the part, slot consistency, and share of the very words.

    Templates that hold too few common words in any order are not aligned: no alignment can cover more.
    """
    item_t, part_t = templates.template(item), templates.template(part)
    there: dict[str, int] = {}
    for w in part_t:
        there[w] = there.get(w, 0) + 1
    common = 0
    for w in item_t:
        n = there.get(w, 0)
        if n:
            there[w] = n - 1
            common += 1
    if common < least * len(item):
        return 0.0, 0.0, 0.0
    pairs = align(item, part, item_t, part_t)
    slots = [(item[i], part[j]) for i, j in pairs if item_t[i] in (NUMBER, NAME, UNIT, DATE)]
    forth, back = {}, {}
    good = sum(forth.setdefault(p, q) == q and back.setdefault(q, p) == p for p, q in slots)
    return len(pairs) / len(item), good / len(slots) if slots else 1.0, sum(item[i] == part[j] for i, j in pairs) / len(item)


def _bitmap(bits: DataFrame) -> bytes:
    """The bitmap of a column ``bit``: at most BITS / 8 bytes come to the driver, however many rows there are."""
    out = np.zeros(BITS // 8, np.uint8)
    packed = bits.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b"))
    for k, b in packed.collect():
        b = np.frombuffer(b, np.uint8)
        out[(k - 1) * len(b) : k * len(b)] = b
    return out.tobytes()


def plain_words(items: DataFrame) -> bytes:
    """Bitmap of the words that some item has as a plain word: in lower case, or never as a name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = {s for t in pdf["text"] for s in sightings(t)}
            yield pd.DataFrame([(w, h, bit_of(w) + 1) for w, h in seen], columns=["word", "how", "bit"]).astype({"how": "int32", "bit": "int64"})

    seen = items.select("text").mapInPandas(run, "word string, how int, bit long")
    return _bitmap(seen.groupBy("word", "bit").agg(F.max("how").alias("how")).where(F.col("how") != _AS_NAME).select("bit"))


def item_windows(classes: DataFrame, plain: bytes, least: float) -> DataFrame:
    """Windows that name items: class_id, h, item_at.

    A window of more than COMMON items is left out where the item's common windows together cover
    less than ``least`` of its words: a document that meets the item in these alone could not cover
    enough. Items with more in common than that (variants of each other) keep them all.
    """
    shared = classes.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"class_id": pdf["class_id"].to_numpy(), "n": [len(w) for w in pdf["words"]], "h": [templates.windows(list(w)) for w in pdf["words"]]})

    every = classes.select("class_id", "words").mapInPandas(run, "class_id long, n long, h array<long>").select("class_id", "n", F.posexplode("h").alias("item_at", "h"))
    spread = every.groupBy("h").agg((F.countDistinct("class_id") > COMMON).alias("common"))
    rated = every.hint("merge").join(spread.hint("merge"), "h")
    places = rated.where("common").select("class_id", "n", F.explode(F.sequence(F.col("item_at"), F.col("item_at") + (WINDOW - 1))).alias("place"))
    alike = places.groupBy("class_id", "n").agg(F.countDistinct("place").alias("covered")).where(F.col("covered") >= F.col("n") * F.lit(least)).select("class_id", F.lit(True).alias("alike"))
    kept = rated.hint("merge").join(alike.hint("merge"), "class_id", "left").where(~F.col("common") | F.col("alike"))
    return kept.select("class_id", "h", "item_at")


def find_leaks(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """Documents that carry text of items: doc_id, item_id, word_share, template_share, consistency.

    A row covers at least ``least`` of the item's template with placeholder fillings that map one to
    one (consistency >= CONSISTENT); word_share is the share of the item's very words in the same
    alignment, lower for copies with other values. Null and empty texts carry nothing; items with
    fewer words than a window are never found; equal items are all reported, as are repeated
    documents. Whole documents are read, once; only those that meet an
    item's window go on, and of them the stretches around the windows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    split = F.pandas_udf(lambda s: s.map(words), "array<string>")
    texts = items.where("item_id is not null and text is not null").select("item_id", "text")
    own = scratch.save(texts.select(F.col("item_id").cast("long").alias("item_id"), split("text").alias("words")))
    classes = own.where(F.size("words") >= WINDOW).groupBy("words").agg(F.min("item_id").alias("class_id"))
    members = own.hint("merge").join(classes.hint("merge"), "words").select("class_id", "item_id")
    plain = plain_words(texts)
    right = scratch.save(item_windows(classes, plain, least))
    wanted = spark.sparkContext.broadcast((plain, _bitmap(right.select((F.pmod("h", F.lit(BITS)) + 1).alias("bit")).distinct())))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates, bitmap = Templates(wanted.value[0]), np.frombuffer(wanted.value[1], np.uint8)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ws = words(text)
                h = templates.windows(ws)
                at = np.flatnonzero(has_bits(bitmap, h % BITS))
                if len(at):
                    out.append((doc, ws, h[at], at.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "words", "h", "at"])

    rows = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = scratch.save(rows.mapInPandas(meet, "doc_id long, words array<string>, h array<long>, at array<int>"))
    left = met.select("doc_id", F.explode(F.arrays_zip("h", "at")).alias("z")).select("doc_id", "z.h", F.col("z.at").alias("doc_at"))
    few = right.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    hits = left.join(F.broadcast(right), "h") if few else left.hint("merge").join(right.hint("merge"), "h")
    # stretches: windows of like offset, in two grids that overlap by half, so that a copy lies wholly in one
    n = F.size("words")
    hits = hits.join(F.broadcast(classes.select("class_id", n.alias("n"))) if few else classes.select("class_id", n.alias("n")).hint("merge"), "class_id")
    step = F.greatest(F.lit(20), F.col("n"))
    offset = F.col("doc_at") - F.col("item_at")
    grids = F.array(*[F.struct(F.lit(g).alias("g"), F.floor((offset + F.floor(step * g / 2)) / step).alias("b")) for g in (0, 1)])
    spread = hits.select("doc_id", "class_id", "n", offset.alias("offset"), F.explode(grids).alias("s"))
    pad = F.floor(F.col("n") / 4) + 10
    lo, hi = F.min("offset") - F.min(pad), F.max("offset") + F.min(F.col("n") + pad)
    first = F.greatest(F.lit(0), lo).cast("int")
    stretches = spread.groupBy("doc_id", "class_id", "s").agg(first.alias("first"), (hi - first).cast("int").alias("length"))
    around = stretches.select("doc_id", "class_id", "first", "length").distinct()
    near = around.hint("merge").join(met.select("doc_id", "words").hint("merge"), "doc_id").select("doc_id", "class_id", F.slice("words", F.col("first") + 1, F.col("length")).alias("part"))
    item_words = classes.select("class_id", F.col("words").alias("item"))
    pairs = near.join(F.broadcast(item_words), "class_id") if few else near.hint("merge").join(item_words.hint("merge"), "class_id")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(wanted.value[0])
        for pdf in batches:
            out = []
            for doc, cls, part, item in zip(pdf["doc_id"], pdf["class_id"], pdf["part"], pdf["item"]):
                covered, good, same = verify(list(item), list(part), templates, least)
                if covered >= least and good >= CONSISTENT:
                    out.append((doc, cls, round(same, 4), round(covered, 4), round(good, 4)))
            yield pd.DataFrame(out, columns=["doc_id", "class_id", "word_share", "template_share", "consistency"])

    checked = pairs.mapInPandas(check, "doc_id long, class_id long, word_share double, template_share double, consistency double")
    best = checked.groupBy("doc_id", "class_id").agg(F.max(F.struct("word_share", "template_share", "consistency")).alias("b"))
    found = best.hint("merge").join(members.hint("merge"), "class_id")
    return found.select("doc_id", "item_id", "b.word_share", "b.template_share", "b.consistency")
