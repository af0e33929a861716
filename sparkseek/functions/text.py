"""Text analysis: one set of rules, as a Column and as plain Python.

Lower case, fold diacritics, take runs of word characters without apostrophes or
hyphens at their edges, drop stop words, stem. Folding maps letters to letters, so
it commutes with the cut into words and both are one pass over the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SeekError
from .stemmer import stem as english_stem

#: Word characters besides letters and marks, and a collation name, by language.
LANGUAGES: dict[str, tuple[str, str]] = {
    **dict.fromkeys(["portuguese", "russian", "spanish", "german", "finnish", "danish", "hungarian", "romanian", "serbian", "turkish", "lithuanian"], ("0-9", "UNICODE")),
    **dict.fromkeys(["arabic", "nepali", "irish", "indian", "armenian", "greek", "indonesian", "ukrainian", "slovenian", "bulgarian", "tamil", "sanskrit"], ("0-9", "UNICODE")),
    **dict.fromkeys(["english", "dutch", "italian"], ("0-9_'\\-", "UNICODE")),
    **dict.fromkeys(["french", "czech", "slovak"], ("0-9\\-", "UNICODE")),
    **dict.fromkeys(["norwegian", "vietnamese"], ("0-9_", "UNICODE")),
    "swedish": ("0-9_\\-", "UNICODE"),
    "multilingual": ("\\p{N}", "UNICODE"),
}
COLLATIONS = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "dutch": "nl", "portuguese": "pt", "swedish": "sv", "danish": "da"}
UNFOLDED = frozenset(["vietnamese"])

#: Scripts without spaces are cut into pairs of neighbouring characters: an
#: approximation of a dictionary's words that finds every word of two or more.
PAIRED = {"japanese": "ja", "korean": "ko", "chinese": "zh"}
_JOINED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー]"
_APART = r"[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー]]"
#: Matches nothing, ahead of each pair, lone character or word of other scripts.
PAIRS = f"(?=({_JOINED}{{2}}|(?<!{_JOINED}){_JOINED}(?!{_JOINED})|(?<!{_APART}){_APART}+))"


def _foldings() -> dict[str, str]:
    """Each letter of U+00C0 to U+017F to its base letter; a few by sound or shape."""
    special = dict(zip("ÆæÐðØøÞþßĐđĦħıĲĳĸŁłŊŋŒœŦŧſ", "AaEeOoPpsDdHhiIikLlNnOoTts", strict=True)) | {"ŀ": "l", "Ŀ": "L", "ŉ": "n"}
    out = {}
    for cp in range(0xC0, 0x180):
        c = chr(cp)
        if c not in "×÷":
            out[c] = special.get(c) or unicodedata.normalize("NFD", c)[0]
    # Letters of other scripts that are one word with their plain form.
    return out | {"Ё": "Е", "ё": "е", "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي"}


FOLD = _foldings()
FOLD_FROM, FOLD_TO = "".join(FOLD), "".join(FOLD.values())


def word_pattern(language: str) -> str:
    """Matches words without the apostrophes and hyphens at their edges."""
    if language in PAIRED:
        return PAIRS
    if language not in LANGUAGES:
        raise SeekError("LANGUAGE_NOT_SUPPORTED", language)
    extra = LANGUAGES[language][0]
    inner = extra.replace("'", "").replace("\\-", "")
    if inner == extra:
        return f"[\\p{{L}}\\p{{M}}{extra}]+"
    return f"[\\p{{L}}\\p{{M}}{inner}](?:[\\p{{L}}\\p{{M}}{extra}]*[\\p{{L}}\\p{{M}}{inner}])?"


@dataclass(frozen=True)
class Analyzer:
    language: str = "english"
    stemming: bool = False
    stop_words: tuple[str, ...] = ()
    allow_duplicates: bool = True
    stemmer: Callable[[str], str] | None = None
    stemmer_skip: frozenset[str] = field(default_factory=frozenset)
    tokenize_skip: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        word_pattern(self.language)
        if self.stemming and self.stemmer is None and self.language != "english":
            raise SeekError("MISSING_STEMMER", self.language)

    def _folds(self) -> bool:
        return self.language not in UNFOLDED

    def stems(self, prop: str | None) -> Callable[[str], str] | None:
        if not self.stemming or prop in self.stemmer_skip:
            return None
        return self.stemmer or english_stem

    def words(self, text: Column, prop: str | None = None) -> Column:
        """array<string> of words before stemming; null text has none."""
        text = F.coalesce(text, F.lit(""))
        if prop in self.tokenize_skip:
            whole = F.regexp_replace(text, "^['-]+|['-]+$", "")
            whole = F.translate(whole, FOLD_FROM, FOLD_TO) if self._folds() else whole
            out = F.filter(F.array(whole), lambda w: w != "")
        else:
            low = F.lower(text)
            if self._folds():
                # Letters that fold are never ASCII.
                low = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))
            out = F.regexp_extract_all(low, F.lit(word_pattern(self.language)), F.lit(1 if self.language in PAIRED else 0))
        if self.stop_words:
            stop = F.array(*[F.lit(w) for w in self.stop_words])
            out = F.filter(out, lambda w: ~F.array_contains(stop, w))
        return out if self.allow_duplicates or self.stems(prop) else F.array_distinct(out)

    def tokens(self, text: str | None, prop: str | None = None) -> list[str]:
        """The same rules for a query's text, stemming included."""
        text = text or ""
        table = str.maketrans(FOLD) if self._folds() else {}
        if prop in self.tokenize_skip:
            found: Iterable[str] = [text.strip("'-").translate(table)]
        else:
            found = regex.findall(word_pattern(self.language), text.lower().translate(table), regex.V1)
        found = [w for w in found if w and w not in self.stop_words]
        stem = self.stems(prop)
        found = [s for w in found if (s := stem(w))] if stem else found
        return found if self.allow_duplicates else list(dict.fromkeys(found))


def collation(language: str) -> str:
    return COLLATIONS.get(language) or PAIRED.get(language, "UNICODE")


SIZES = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB")


def format_bytes(n: Column, decimals: int = 2) -> Column:
    """1536 as "1.5 KB"; powers of 1024, no zeros at the end."""
    out = F.concat(n.cast("string"), F.lit(f" {SIZES[0]}"))
    for i, unit in enumerate(SIZES[1:], 1):
        part = F.round(n / float(1024**i), max(0, decimals)).cast(f"decimal(30, {max(0, decimals)})").cast("string")
        short = F.regexp_replace(part, r"\.?0+$", "") if decimals > 0 else part
        out = F.when(n >= 1024**i, F.concat(short, F.lit(f" {unit}"))).otherwise(out)
    return out


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
