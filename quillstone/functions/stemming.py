"""English stems with word types: Porter's second algorithm as published (snowballstem.org, the English stemmer).

Added to it: negating beginnings and superlatives are cut first, -less and -hood are suffixes, contractions of `not`
give their auxiliary, and each suffix met gives the word types; `word_type` ranks those. Which suffix goes is decided by
the longest one that fits, as in the published algorithm; what a stem gets back after -ed and -ing are its repairs (e
after at, bl, iz and in short words, one letter for doubled ones).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..runtime import java_function

# Words of closed classes, tested in this order when a word has no type but Plural.
CLASSES = {
    "Male": "he him his himself man men boy husband actor",
    "Female": "she her herself woman women girl wife actress",
    "Article": "a an the",
    "Conjunction": "for and nor but or yet so than as that if when because while where after though whether before although like once unless now except",
    "Adposition": "in during at on since until above across against along among around behind below beneath beside between by down from into near of off to toward under upon with within",
    "ConjunctiveAdverb": "also thus",
    "Verb": "has had have was were may might must shall should can could will would is am are be being been do does did",
    "Number": "one two three four five six seven eight nine ten twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million",
}
# Words that the steps leave alone, with their stems and types.
WHOLE = {
    "skis": ("ski", "Noun Plural"), "skies": ("sky", "Noun Plural"), "dying": ("die", "Verb"), "lying": ("lie", "Verb"), "tying": ("tie", "Verb"),
    "idly": ("idle", "AdverbOfManner"), "gently": ("gentle", "AdverbOfManner"), "ugly": ("ugli", "Adjective"), "early": ("earli", "Adjective AdverbOfManner"),
    "only": ("onli", ""), "singly": ("singl", "AdverbOfManner"), "sky": ("sky", "Noun"), "news": ("news", "Noun"), "howe": ("howe", ""), "atlas": ("atlas", "Noun"),
    "cosmos": ("cosmos", "Noun"), "bias": ("bias", "Noun"), "andes": ("andes", "Noun Plural"), "texas": ("texas", "Noun"),
}
# Words that stay after the plural step, with their types.
AFTER_PLURAL = {"inning": "Noun", "outing": "Noun", "canning": "Noun", "herring": "Noun", "earring": "Noun", "proceed": "Verb", "exceed": "Verb", "succeed": "Verb"}
# Beginnings whose first region ends with them.
REGION_STARTS = ("gener", "arsen", "commun")
# Suffixes of step 2, replacements and types.
STEP2 = (
    ("ization", "ize", "Suffix"), ("ational", "ate", "Suffix Adjective"), ("ousness", "ous", "Suffix"), ("iveness", "ive", "Suffix"), ("fulness", "ful", "Suffix"),
    ("tional", "tion", "Suffix Adjective"), ("lessli", "less", "AdverbOfManner"), ("biliti", "ble", "AdverbOfManner Noun Suffix"), ("entli", "ent", "AdverbOfManner"),
    ("ation", "ate", "Suffix"), ("alism", "al", ""), ("aliti", "al", "Noun Suffix"), ("fulli", "ful", "AdverbOfManner"), ("ousli", "ous", "AdverbOfManner"),
    ("iviti", "ive", "Noun Suffix"), ("enci", "ence", ""), ("anci", "ance", ""), ("abli", "able", "AdverbOfManner"), ("izer", "ize", ""), ("ator", "ate", ""),
    ("alli", "al", "AdverbOfManner"), ("bli", "ble", "AdverbOfManner"),
)
# Suffixes of step 3, replacements and types.
STEP3 = (
    ("ational", "ate", "Suffix Adjective"), ("tional", "tion", "Suffix Adjective"), ("alize", "al", ""), ("icate", "ic", ""), ("iciti", "ic", "Noun Suffix"),
    ("ical", "ic", "Suffix Adjective"), ("ful", "", "Adjective"), ("ness", "", "Suffix"),
)
# Suffixes that step 4 deletes (all but the s or t of the last two), and types.
STEP4 = (
    ("al", "Suffix Adjective"), ("ance", "Suffix"), ("ence", "Suffix"), ("er", ""), ("ic", "Suffix Adjective"), ("able", "Suffix"), ("ible", "Suffix"), ("ant", "Suffix"),
    ("ement", ""), ("ment", ""), ("ent", "Suffix"), ("ou", ""), ("ism", ""), ("ate", ""), ("iti", "Suffix Noun"), ("ous", "Suffix Adjective"), ("ive", "Suffix"), ("ize", ""),
    ("sion", "Suffix"), ("tion", "Suffix"),
)
# Codes of word types, the first that a word has.
TYPE_CODES = {
    "Verb": 1, "Noun": 2, "Adjective": 3, "Male": 4, "Female": 5, "Article": 6, "Conjunction": 7, "Adposition": 8, "ConjunctiveAdverb": 9,
    "AdverbOfManner": 11, "Suffix": 12, "Prefix": 13, "Plural": 10,
}
_CLASS_OF: dict[str, str] = {}
for _name, _words in CLASSES.items():
    for _w in _words.split():
        _CLASS_OF.setdefault(_w, _name)

# Nouns and verbs that only look like superlatives.
NO_SUPERLATIVES = frozenset("""forest honest modest interest harvest tempest conquest request inquest bequest suggest protest arrest invest divest
digest ingest contest manifest attest detest molest earnest priest guest quest chest crest behest infest ernest everest budapest bucharest
northwest southwest""".split())
# Auxiliaries whose contraction with `not` changes them; others just lose it.
CONTRACTED = {"can't": "can", "won't": "will", "shan't": "shall", "ain't": "be"}
# Negating or grading beginnings: what is cut, if so many letters follow (irr- and unn- keep the letter that was doubled).
BEGINNINGS = {"ir": ("irr", 5), "un": ("unn", 5), "over": ("over", 6), "under": ("under", 7), "non-": ("non-", 7), "non": ("non", 6), "anti-": ("anti-", 7), "dis-": ("dis-", 6)}
VOWELS = frozenset("aeiouy")
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
LI_ENDINGS = frozenset("cdeghkmnrt")


class _Word:
    """A word on its way to its stem: its letters, where its regions begin, and the types met."""

    def __init__(self, letters: str) -> None:
        self.types: set[str] = set()
        self.text = letters

    def regions(self) -> None:
        """Y marks a y that is a consonant; r1 begins after the first consonant that follows a vowel, r2 after the next such."""
        marked: list[str] = []
        for c in self.text:
            marked.append("Y" if c == "y" and (not marked or marked[-1] in VOWELS) else c)
        self.text = "".join(marked)
        start = next((s for s in REGION_STARTS if self.text.startswith(s)), None)
        self.r1 = self.after_pair(0) if start is None else len(start)
        self.r2 = self.after_pair(self.r1)

    def after_pair(self, at: int) -> int:
        for k in range(at + 1, len(self.text)):
            if self.text[k - 1] in VOWELS and self.text[k] not in VOWELS:
                return k + 1
        return len(self.text)

    def suffix(self, table: Iterable[str]) -> str | None:
        """The longest suffix of the table that leaves something before it."""
        return max((s for s in table if self.text.endswith(s) and len(s) < len(self.text)), key=len, default=None)

    def cut(self, suffix: str, put: str = "", kinds: str = "") -> None:
        self.text = self.text[: len(self.text) - len(suffix)] + put
        self.types.update(kinds.split())

    def holds(self, region: int, suffix: str) -> bool:
        return len(self.text) - len(suffix) >= region

    def vowel_before(self, end: int) -> bool:
        return any(c in VOWELS for c in self.text[:end])

    def short_end(self, text: str) -> bool:
        """Whether text ends in a short syllable."""
        if len(text) == 2:
            return text[0] in VOWELS and text[1] not in VOWELS
        return len(text) > 2 and text[-3] not in VOWELS and text[-2] in VOWELS and text[-1] not in VOWELS and text[-1] not in "wxY"

    def mend(self) -> None:
        """The end that a stem had before a suffix joined it: e after at, bl, iz and in short words, one letter for doubles."""
        if self.text.endswith(("at", "bl", "iz")):
            self.text += "e"
        elif self.text[-2:] in DOUBLES:
            self.text = self.text[:-1]
        elif self.r1 >= len(self.text) and self.short_end(self.text):
            self.text += "e"


def _quotes_off(word: str) -> str:
    """Without leading apostrophes, as many closing ones, and a hyphen left at the end."""
    inner = word.lstrip("'")
    if not inner:
        return word[-1:]
    opened = len(word) - len(inner)
    closed = len(inner) - len(inner.rstrip("'"))
    return inner[: len(inner) - min(opened, closed)].removesuffix("-")


def _beginning(w: _Word) -> None:
    for cut, (start, least) in BEGINNINGS.items():
        if w.text.startswith(start) and len(w.text) >= least:
            w.text = w.text[len(cut) :]
            w.types.add("Prefix")
            return


def _superlative(w: _Word) -> None:
    """-est goes from words of six letters or more with a vowel before it, and from shorter ones that double a letter or end in -iest."""
    rest = w.text[:-3]
    if not w.text.endswith("est") or w.text in NO_SUPERLATIVES or len(rest) < 2 or not any(c in VOWELS for c in rest):
        return
    if rest[-1] == "i":
        rest = rest[:-1] + "y"
    elif len(rest) > 3 and rest[-2:] in DOUBLES:
        rest = rest[:-1]
    elif len(rest) < 3:
        return
    elif rest[-1] in "cvz" or rest.endswith(("rg", "dg")) or (rest[-1] == "l" and rest[-2] not in "aeiouyl") or (len(rest) == 3 and rest[1] in VOWELS and w.short_end(rest)):
        rest += "e"  # nice, brave, large, simple, wide
    w.text = rest
    w.types.add("Adjective")


def _possessive(w: _Word) -> None:
    s = w.suffix(("'", "'s", "'s'"))
    if s:
        w.cut(s, kinds="Plural")


def _plural(w: _Word) -> None:
    s = w.suffix(("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w.cut(s, "ss", "Plural")
    elif s in ("ied", "ies"):
        w.cut(s, "i" if len(w.text) > 4 else "ie", "Verb" if s == "ied" else "Plural")
    elif s == "s" and w.vowel_before(len(w.text) - 2):
        w.cut(s, kinds="Plural")
    elif w.text in CONTRACTED:
        w.text = CONTRACTED[w.text]
        w.types.add("Prefix")
    elif len(w.text) > 4 and w.text.endswith("n't"):
        w.cut("n't", kinds="Prefix")
    elif len(w.text) > 7 and w.text.endswith("hood"):
        w.cut("hood")


def _tense(w: _Word) -> None:
    s = w.suffix(("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s is None:
        return
    manner = " AdverbOfManner" if s.endswith("ly") else ""
    if s.startswith("ee"):
        w.types.update(manner.split())
        if w.holds(w.r1, s):
            w.cut(s, "ee")
    elif w.vowel_before(len(w.text) - len(s)):
        w.cut(s, kinds="Verb" + manner)
        w.mend()


def _final_y(w: _Word) -> None:
    if len(w.text) > 2 and w.text[-1] in "yY" and w.text[-2] not in VOWELS:
        w.cut(w.text[-1], "i")


_TABLE2 = {s: (to, kinds) for s, to, kinds in STEP2} | {"ogi": ("og", ""), "li": ("", "AdverbOfManner")}
_TABLE3 = {s: (to, kinds) for s, to, kinds in STEP3} | {"ative": ("", "Suffix")}
_TABLE4 = {s: kinds for s, kinds in STEP4}


def _derived(w: _Word) -> None:
    """Suffixes that became others."""
    s = w.suffix(_TABLE2)
    if s and w.holds(w.r1, s) and not (s == "ogi" and w.text[-4] != "l") and not (s == "li" and w.text[-3] not in LI_ENDINGS):
        w.cut(s, *_TABLE2[s])
    s = w.suffix(_TABLE3)
    if s and w.holds(w.r2 if s == "ative" else w.r1, s):
        w.cut(s, *_TABLE3[s])
    if len(w.text) > 5 and w.text.endswith("less"):
        w.cut("less", kinds="Adjective")
    s = w.suffix(_TABLE4)
    if s in ("sion", "tion"):
        if w.holds(w.r2, "ion"):
            w.cut("ion", kinds=_TABLE4[s])
    elif s and w.holds(w.r2, s):
        w.cut(s, kinds=_TABLE4[s])


def _final_letter(w: _Word) -> None:
    if w.text.endswith("e"):
        if w.holds(w.r2, "e") or (w.holds(w.r1, "e") and not w.short_end(w.text[:-1])):
            w.cut("e")
    elif w.text.endswith("ll") and w.holds(w.r2, "l"):
        w.cut("l")


@lru_cache(maxsize=65_536)
def stem(word: str) -> tuple[str, tuple[str, ...]]:
    """The stem of a lower-case word (letters, ' and -), and its types in order of name; an empty word has neither."""
    w = _Word(_quotes_off(word))
    _beginning(w)
    _superlative(w)
    done = WHOLE.get(w.text)
    if done is None and len(w.text) > 2:
        w.regions()
        _possessive(w)
        _plural(w)
        done = (w.text, AFTER_PLURAL[w.text]) if w.text in AFTER_PLURAL else None
        if done is None:
            for step in (_tense, _final_y, _derived, _final_letter):
                step(w)
            w.text = w.text.replace("Y", "y")
    if done is not None:
        w.text = done[0]
        w.types.update(done[1].split())
    elif w.types <= {"Plural"} and w.text in _CLASS_OF:
        w.types.add(_CLASS_OF[w.text])
    return w.text, tuple(sorted(w.types))


def word_type(types: tuple[str, ...] | set[str]) -> int:
    """The code of the first type that a word has: 14 for others, 15 for none."""
    return next((code for name, code in TYPE_CODES.items() if name in types), 14 if types else 15)


_STEMS = StructType([StructField("stem", StringType()), StructField("types", ArrayType(StringType())), StructField("code", IntegerType())])


@F.pandas_udf(_STEMS)
def stems(words: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """stem, types and code of each word; a null word has nulls. Meant for distinct words."""
    for batch in words:
        done = [(None, None, None) if w is None else (*(s := stem(w)), word_type(s[1])) for w in batch]
        yield pd.DataFrame([(a, None if b is None else list(b), c) for a, b, c in done], columns=["stem", "types", "code"])


stems = stems.asNondeterministic()  # or a filter on the types would stem every word once more


def word_counts(spark: SparkSession, text, marks: bool) -> Column:
    """The distinct words of a lower-case text (binary) and how often each comes: rows of word and n; with marks also whether right after `the`.

    Words are [a-z]+, with marks '?[a-z][a-z'-]*.
    """
    pair = [StructField("after_the", BooleanType())] if marks else []
    return java_function(spark, "WordCounts", ArrayType(StructType([StructField("word", StringType()), *pair, StructField("n", LongType())])), marks)(text)
