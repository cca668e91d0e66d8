"""Text that looks the same made the same: classes of look-alikes, their representatives, rewriting.

Look-alike classes are transitive: union-find joins code points and strings that a table or Unicode's
compatibility mappings put together. The corpus' counts choose for each class and script the most frequent
member. A text is rewritten by a multi-pattern automaton, leftmost and longest first, word by word: a word's
script is that of its letters that look like no other script's; without such letters it is that of the nearest
words that have some. Invisible characters, odd spaces and accents apart from their letters are put right on
the way. What a script or its typography needs stays: joiners in Arabic or Indic words and in emoji, full-width
punctuation beside ideographs, French spaces beside marks, the hyphen at a broken line's end.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

# Letters that readers can't tell from a Latin one, by script, each followed by its Latin twin.
CYRILLIC = "ьb аa сc еe оo рp хx уy іi јj ѕs ԁd һh ӏl ԛq ԝw ѵv АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ԌG ԚQ ԜW Ӏl ҮY үy"
GREEK = "οo νv ρp ιi κk υu χx αa γy ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
ARMENIAN = "օo ոn սu հh զq յj ցg ՕO ՍU Տs ԼL"
OTHER = "ɡg ɑa ꞁl ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
COPTIC = "ⲟo ⲣp ⲥc ⲭx ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX"
# Pairs of letters of which Unicode has a character that shows both.
_DIGRAPHS = frozenset("AA AO AU AV AY OO TZ VY DZ TS LS LZ".split())
# Spaces that stand for the plain one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u3164\uffa0\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f"

_JOINING = regex.compile(
    r"[\p{Arabic}\p{Syriac}\p{Nko}\p{Mandaic}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}"
    r"\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Tibetan}\p{Myanmar}\p{Khmer}\p{Thai}\p{Lao}\p{Hebrew}]"
)
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}\uFE0F\u20E3\U000E0020-\U000E007F]")
_IDEOGRAPH = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}\u3000-\u303F]")
_FRENCH_BEFORE, _FRENCH_AFTER = ";:!?»%€", "«"
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nl}]+")
_SCRIPT = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Cyrillic", "Greek", "Armenian")}


class UnionFind:
    """Disjoint sets of strings; the root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def script_of(member: str) -> str:
    """The script of a class's member; forms of other widths and styles are members of no script."""
    if unicodedata.decomposition(member[0]).startswith("<"):
        return "Form"
    if len(member) == 1 and (member in _twins("other") or member in _twins("coptic") or member in _named()):
        return "Form"
    return next((s for s, r in _SCRIPT.items() if r.match(member)), "Common")


@lru_cache(maxsize=8)
def _twins(which: str) -> dict[str, str]:
    table = {"cyrillic": CYRILLIC, "greek": GREEK, "armenian": ARMENIAN, "other": OTHER, "coptic": COPTIC}[which]
    return {pair[0]: pair[1:] for pair in table.split()}


def _forms() -> Iterator[tuple[str, str]]:
    """Characters that are another's width, style, presentation form or ligature, with that other."""
    for point in range(0x80, 0x110000):
        kind, _, rest = unicodedata.decomposition(chr(point)).partition("> ")
        if not kind.startswith("<"):
            continue
        plain = "".join(chr(int(x, 16)) for x in rest.split())
        plain = unicodedata.normalize("NFKC", plain)
        if kind in ("<wide", "<narrow", "<font", "<initial", "<medial", "<final", "<isolated"):
            yield chr(point), plain
        elif kind == "<compat" and plain.isalpha() and unicodedata.category(chr(point)) in ("Nl", "Ll", "Lu", "Lo"):
            yield chr(point), plain


@lru_cache(maxsize=1)
def _named() -> dict[str, str]:
    """Characters whose Unicode name says that they are a letter's small capital or two letters set as one."""
    out = {}
    for point in range(0x180, 0xAC00):
        name = unicodedata.name(chr(point), "")
        if m := re.fullmatch(r"LATIN LETTER SMALL CAPITAL ([A-Z])", name):
            out[chr(point)] = m[1].lower()
        elif point >= 0x2A0 and (m := re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z])([A-Z])(?: DIGRAPH)?", name)) and not unicodedata.decomposition(chr(point)):
            pair = m[2] + m[3]
            if pair not in _DIGRAPHS:
                continue
            out[chr(point)] = pair if m[1] == "CAPITAL" else pair.lower()
    return out


@lru_cache(maxsize=1)
def look_alike_classes() -> dict[str, list[str]]:
    """All classes with at least two members."""
    sets = UnionFind()
    for which in ("cyrillic", "greek", "armenian", "other", "coptic"):
        for a, b in _twins(which).items():
            sets.union(a, b)
    for a, b in _named().items():
        sets.union(a, b)
    for a, b in _forms():
        if a not in INVISIBLE:
            sets.union(a, b)
    for k, a in (("K", "K"), ("Å", "Å"), ("Ω", "Ω")):
        sets.union(k, a)
    return sets.classes()


@lru_cache(maxsize=1)
def _marks() -> frozenset[str]:
    return frozenset(chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc"))


class Canon:
    """Representatives by the corpus' counts, and the automata that rewrite with them."""

    def __init__(self, counts: dict[str, int]):
        import ahocorasick

        def often(member: str) -> tuple:
            return (-min(counts.get(c, 0) for c in member), len(member), member)

        self.target: dict[str, dict[str, str]] = {}
        twins = Counter()
        for members in look_alike_classes().values():
            by_script: dict[str, list[str]] = {}
            for m in members:
                by_script.setdefault(script_of(m), []).append(m)
            for script, own in by_script.items():
                if script == "Form":
                    continue
                best = min(own, key=often)
                to = self.target.setdefault(script, {})
                to.update((m, best) for m in members if m != best and not (script == "Common" and m.isascii()))
            for m in members:
                if len({script_of(x) for x in members} - {"Form"}) > 1:
                    twins[m] += 1
        # Plain characters of no script, and forms of letters where no word decides.
        self.shared = set(twins)
        self.automata = {}
        for script, table in self.target.items():
            machine = ahocorasick.Automaton()
            for m, to in table.items():
                machine.add_word(m, (len(m), to))
            machine.make_automaton()
            self.automata[script] = machine
        single = {m for t in self.target.values() for m in t if len(m) == 1 and not m.isascii()}
        self.suspects = frozenset(single | set(SPACES) | set(INVISIBLE) | _marks())
        self.suspect_points = np.zeros(0x110000, dtype=bool)
        self.suspect_points[[ord(c) for c in self.suspects]] = True
        self.loose = regex.compile(rf"[{regex.escape(INVISIBLE, special_only=True)}]")
        self.spaces = regex.compile(rf"[{regex.escape(SPACES, special_only=True)}]")
        self.common = frozenset(m for m in self.target.get("Common", {}) if len(m) == 1 and not m.isalpha())

    def odd(self, text: str) -> bool:
        """Whether any character might stand for another one."""
        if len(text) < 64:
            return not self.suspects.isdisjoint(text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return bool(self.suspect_points[points].any())

    @lru_cache(maxsize=1 << 16)
    def rewrite(self, word: str, script: str) -> str:
        """Every member of a class in ``word`` replaced by the class's representative of ``script``."""
        out, at = [], 0
        for end, (size, to) in self.automata[script].iter_long(word):
            out += [word[at : end + 1 - size], to]
            at = end + 1
        return "".join(out) + word[at:]

    def strong(self, text: str) -> Counter:
        """Letters by script, without those that look like another script's."""
        return Counter(filter(None, map(self._tells, text)))

    @lru_cache(maxsize=1 << 16)
    def _tells(self, c: str) -> str | None:
        if c in self.shared or not c.isalpha():
            return None
        return next((s for s, p in _SCRIPT.items() if p.match(c)), None)

    def _around(self, text: str, start: int, end: int) -> str | None:
        """The script of the nearest letters that tell one, however far they are."""
        reach = 3
        while reach < max(start, len(text) - end):
            reach *= 4
            near = self.strong(text[max(0, start - reach) : start]) + self.strong(text[end : end + reach])
            if near:
                return near.most_common(1)[0][0]
        return None

    @lru_cache(maxsize=1 << 16)
    def _scripts(self, word: str) -> tuple[str | None, frozenset[str]]:
        """The script that a word's letters tell, if any does, and the scripts of all its letters."""
        told = self.strong(word)
        present = frozenset(s for c in set(word) for s, p in _SCRIPT.items() if p.match(c))
        return (told.most_common(1)[0][0] if told else None), present

    def word(self, text: str, start: int, end: int) -> str:
        word = text[start:end]
        script, present = self._scripts(word)
        if script is None:
            if not present:
                return word
            if present == {"Latin"} and not self.odd(word):
                return word
            script = self._around(text, start, end) or max(present, key=lambda s: (s == "Latin", s))
        return self.rewrite(word, script) if script in self.automata else word

    def text(self, text: str) -> tuple[str, bool]:
        """The text in its one form, and whether anything stood for something else."""
        if text.isascii() or not self.odd(text):
            return text, False
        out = self._drop_invisible(text)
        out = self.spaces.sub(lambda m: self._space(m, out), out) if self.spaces.search(out) else out
        parts, at = [], 0
        for m in _WORD.finditer(out):
            if self.odd(m[0]):
                new = self.word(out, m.start(), m.end())
                if new != m[0]:
                    parts += [out[at : m.start()], new]
                    at = m.end()
        out = "".join(parts) + out[at:]
        out = self._marks_of(out)
        out = unicodedata.normalize("NFC", out)
        return out, out != text

    def _drop_invisible(self, text: str) -> str:
        def keep(m: regex.Match) -> str:
            c, a, b = m[0], m.start(), m.end()
            before, after = text[a - 1 : a], text[b : b + 1]
            if c == "\u00ad":  # at a broken line's end
                return c if before.isalpha() and (not after or after in "\r\n") else ""
            if _JOINING.match(before or " ") and (c in "\u200e\u200f\u061c" or _JOINING.match(after or " ")):
                return c
            if _JOINING.match(after or " ") and c in "\u200e\u200f\u061c":
                return c
            if c in "\u200d︎️" and (_EMOJI.match(before or " ") or before == "\u200d" and a > 1):
                return c
            if c == "️" and before in "0123456789#*" and after == "⃣":
                return c
            return ""

        return self.loose.sub(keep, text) if self.loose.search(text) else text

    @staticmethod
    def _space(m: regex.Match, text: str) -> str:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if m[0] in "\u00a0\u202f" and (after and after in _FRENCH_BEFORE or before and before in _FRENCH_AFTER):
            return m[0]
        return " "

    def _marks_of(self, text: str) -> str:
        if self.common.isdisjoint(text):
            return text
        return "".join(self._mark(c, k, text) if c in self.common else c for k, c in enumerate(text))

    def _mark(self, mark: str, at: int, text: str) -> str:
        beside = text[max(0, at - 1) : at] + text[at + 1 : at + 2]
        if any(_IDEOGRAPH.match(c) or unicodedata.east_asian_width(c) == "F" and not c.isalnum() for c in beside):
            if any(_IDEOGRAPH.match(c) for c in text[max(0, at - 3) : at + 4]):
                return mark
        return self.target["Common"].get(mark, mark)

    def words(self, words: list[str | None]) -> list[tuple[int, str]]:
        """The words that change, each with its place, their neighbours on the page being their context."""
        changed = []
        for k, word in enumerate(words):
            if word and not word.isascii() and self.odd(word):
                # Neighbours give the script; the word itself is cut out again by marks no text has.
                before, after = words[max(0, k - 12) : k], words[k + 1 : k + 13]
                if not any(self.strong(w) for w in (*before, *after) if w):
                    before, after = words[:k], words[k + 1 :]
                new = self._one(word, " ".join(w for w in before if w), " ".join(w for w in after if w))
                if new != word:
                    changed.append((k, new))
        return changed

    def _one(self, word: str, before: str, after: str) -> str:
        out = self._drop_invisible(word)
        out = self.spaces.sub(" ", out)
        whole, shift = f"{before} {out} {after}", len(before) + 1
        parts, at = [], 0
        for m in _WORD.finditer(out):
            if self.odd(m[0]):
                parts += [out[at : m.start()], self.word(whole, shift + m.start(), shift + m.end())]
                at = m.end()
        out = "".join(parts) + out[at:]
        out = self._marks_of(out)
        # A space that the word carried beside it isn't part of the word.
        return unicodedata.normalize("NFC", out.strip(" ") if word.strip(" ") == word else out)


def character_counts(artifacts: DataFrame, pages: DataFrame) -> dict[str, int]:
    """Counts of the characters that are members of look-alike classes, over all texts and words.

    The driver gets one row a code point, of which there are at most a few thousand.
    """

    def run(batches):
        interesting = {c for ms in look_alike_classes().values() for m in ms for c in m}
        for batch in batches:
            counts: Counter = Counter()
            for value in batch.column(0).to_pylist():
                counts.update(value or "")
            rows = [(c, n) for c, n in counts.items() if c in interesting]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["c", "n"]
            )

    texts = artifacts.select("text").unionByName(pages.select(F.array_join("words.text", " ").alias("text")))
    rows = texts.mapInArrow(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r.c: r.n for r in rows}


def canonical_texts(df: DataFrame, text: str, counts: dict[str, int], keep: list[str]) -> DataFrame:
    """``keep``, ``text`` in its one form, ``changed``. Null stays null; an empty text stays empty."""
    schema = df.select(*keep, text).schema.add("changed", BooleanType())

    def run(batches):
        canon = Canon(counts)
        for batch in batches:
            pairs = [(None, False) if t is None else canon.text(t) for t in batch.column(text).to_pylist()]
            out = [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def canonical_words(pages: DataFrame, counts: dict[str, int], keep: list[str], *, only_changed: bool) -> DataFrame:
    """Words of pages in their one form.

    With ``only_changed`` a row a changed word: ``keep, word_no, text``; else a row a page: ``keep, words``.
    Null words stay null; a page without words has an empty list.
    """
    schema = pages.select(*keep).schema
    if only_changed:
        schema = schema.add("word_no", IntegerType()).add("text", StringType())
    else:
        schema = schema.add("words", ArrayType(StringType()))

    def run(batches):
        canon = Canon(counts)
        for batch in batches:
            rows, numbers, texts = [], [], []
            for i, words in enumerate(w for at in range(0, batch.num_rows, 256) for w in batch.column("__words").slice(at, 256).to_pylist()):
                words = words or []
                changed = canon.words(words)
                if only_changed:
                    rows += [i] * len(changed)
                    numbers += [k for k, _ in changed]
                    texts += [t for _, t in changed]
                else:
                    rows.append(i)
                    new = list(words)
                    for k, t in changed:
                        new[k] = t
                    texts.append(new)
            at = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(at) for c in keep]
            if only_changed:
                columns += [pa.array(numbers, pa.int32()), pa.array(texts, pa.string())]
            else:
                columns.append(pa.array(texts, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    words = pages.select(*keep, F.col("words.text").alias("__words"))
    if only_changed:  # most pages have nothing but plain characters; they don't leave the JVM
        words = words.filter(F.exists("__words", lambda w: w.rlike(r"[^\x00-\x7f]")))
    return words.mapInArrow(run, schema)


def found(artifacts: DataFrame, pages: DataFrame) -> DataFrame:
    """``field, id, page_no, word_no`` of every text and word that had to change. A repeated row counts once."""
    counts = character_counts(artifacts, pages)
    odd = artifacts.filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    texts = canonical_texts(odd, "text", counts, ["id"]).filter("changed").select(
        F.lit("artifact").alias("field"), "id", F.lit(0).alias("page_no"), F.lit(0).alias("word_no")
    )
    words = canonical_words(pages, counts, ["source_id", "page_no"], only_changed=True)
    words = words.select(F.lit("word").alias("field"), F.col("source_id").alias("id"), "page_no", "word_no")
    return texts.union(words).distinct()
