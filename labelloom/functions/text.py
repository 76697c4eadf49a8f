"""Text normalisation as native column expressions.

A :class:`TextProfile` holds the few things that depend on the script: which characters
are folded or dropped, and which ones survive.  ``ARABIC`` is the profile the published
ids were computed with; ``ANY_SCRIPT`` keeps every letter and folds case, so that the same
operators serve corpora in other scripts.

Everything stays on the JVM except NFKC, which Spark does not offer: that single step is an
Arrow UDF, and only texts that hold a character NFKC may change are sent through it.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from labelloom.functions.arrays import let

# --------------------------------------------------------------------------- fixed values
# White space as Unicode-aware matching understands it (Java's \s is ASCII only).
WS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Same class behind a cheap first test, so that letters are rejected at once; and without the
# blank itself.
SPACE = rf"[[\x00-\x20\x85\xa0\x{{1680}}-\x{{3000}}]&&[{WS}]]"
OTHER_SPACE = rf"[[\x00-\x1f\x85\xa0\x{{1680}}-\x{{3000}}]&&[{WS}]]"
URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"
MENTION = r"@[\p{L}\p{N}_]+"
LONG_RUN = r"(?d)(.)\1{2,}"

# Letter folds of the full profile: four alef forms, two yeh forms, teh marbuta.
ALEF, YEH, HEH = "\u0627", "\u064A", "\u0647"
ALEF_FORMS = "\u0622\u0623\u0625\u0671"
YEH_FORMS = "\u0649\u0626"
TEH_MARBUTA = "\u0629"
TATWEEL = "\u0640"
# Marks deleted by the full profile: U+064B-U+0652, U+0670, U+06D6-U+06ED.
MARKS = "".join(map(chr, [*range(0x064B, 0x0653), 0x0670, *range(0x06D6, 0x06EE)]))
# Letters kept by the full profile: U+0621-U+063A, U+0641-U+064A, U+0671-U+06D3.
ARABIC_LETTERS = r"\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0671}-\x{06D3}"

# The minimal rule: three alef forms, and these emoji ranges (behind a cheap first test).
MINIMAL_ALEF = r"[\x{0622}-\x{0625}&&[\x{0625}\x{0623}\x{0622}]]"
MINIMAL_SYMBOLS = (
    r"[[\x{24C2}-\x{1F6FF}]&&"
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]]+"
)

# The bag-of-words rule: ASCII and Arabic punctuation and marks are deleted (no space is left).
BAG_PUNCTUATION = string.punctuation + "\xf7\xd7\u061B\u0640\u060C\u061F\xa6\u2026\u2013"
BAG_MARKS = "".join(map(chr, range(0x064B, 0x0653)))
BAG_FOLD_FROM = "\u0625\u0623\u0622\u0649\u0624\u0626\u0629\u06AF"
BAG_FOLD_TO = "\u0627\u0627\u0627\u064A\u0621\u0621\u0647\u0643"

# Persian yeh and kaf, folded only in the canonical key.
PERSIAN_FROM, PERSIAN_TO = "\u06CC\u06A9", "\u064A\u0643"
# What NFKC may change: characters outside these ranges, in which every character is its own normal form and melts with none before it, and
# marks that follow each other, which may be put in order.
STABLE = (r"\x00-\x9f\xbf-\x{131}\x{180}-\x{1c3}\x{3fa}-\x{52f}\x{600}-\x{652}\x{679}-\x{70d}"
          r"\x{2012}-\x{2016}\x{2018}-\x{2023}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{1f300}-\x{1f6d7}")
MAY_CHANGE = rf"[^{STABLE}]|\p{{M}}\p{{M}}"
#: Texts a worker holds as Python strings at a time.
SLICE = 64
# --------------------------------------------------------------------------- end fixed values


@dataclass(frozen=True)
class TextProfile:
    """Script-dependent part of the full normalisation.

    ``fold_from``/``fold_to`` map characters one to one, ``drop`` lists characters that
    vanish, ``letters`` is the inside of a regex class of the characters that survive.
    """

    name: str
    letters: str
    fold_from: str = ""
    fold_to: str = ""
    drop: str = ""
    lowercase: bool = False
    key_fold_from: str = ""
    key_fold_to: str = ""


ARABIC = TextProfile(
    name="arabic",
    letters=ARABIC_LETTERS,
    fold_from=ALEF_FORMS + YEH_FORMS + TEH_MARBUTA,
    fold_to=ALEF * 4 + YEH * 2 + HEH,
    drop=MARKS + TATWEEL,
    key_fold_from=PERSIAN_FROM,
    key_fold_to=PERSIAN_TO,
)
ANY_SCRIPT = TextProfile(name="any_script", letters=r"\p{L}", lowercase=True)


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _swap(col: Column, old: str, new: str, drop: str = "") -> Column:
    """One ``translate``: ``old`` -> ``new`` character by character, ``drop`` removed.  A text
    without any non-ASCII character is passed by when only those are concerned."""
    if not old + drop:
        return col
    if any(c.isascii() for c in old + drop):
        return F.translate(col, old + drop, new)
    return _unless_ascii(col, lambda t: F.translate(t, old + drop, new))


def _unless_ascii(col: Column, change: Callable[[Column], Column]) -> Column:
    return let(col, lambda t: F.when(F.length(t) != F.octet_length(t), change(t)).otherwise(t))


def _without_links(col: Column, by: str) -> Column:
    """Links, then mentions, replaced; a regex runs only where its fixed part occurs."""
    urls = let(
        col,
        lambda t: F.when(
            F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")), F.regexp_replace(t, URL, by)
        ).otherwise(t),
    )
    return let(
        urls,
        lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, MENTION, by)).otherwise(t),
    )


def words(col: Column) -> Column:
    """White-space separated words, empty ones removed."""
    return F.filter(F.split(F.regexp_replace(col, OTHER_SPACE, " "), " "), lambda w: w != "")


def word_count(col: Column | str) -> Column:
    return F.size(words(_text(col)))


def full(col: Column | str, profile: TextProfile = ARABIC) -> Column:
    """Full normalisation: links and mentions go, letter variants are folded, marks deleted,
    runs of three or more equal characters shrink to one, everything but letters is a space.

    ``#``, emoji and symbols need no step of their own: they are no letters, so the last step
    turns them into spaces, and until then they separate runs just as a space would.
    """
    t = _text(col)
    if profile.lowercase:
        t = F.lower(t)
    t = _swap(_without_links(t, " "), profile.fold_from, profile.fold_to, profile.drop)
    t = F.regexp_replace(t, LONG_RUN, "$1")
    return F.trim(F.regexp_replace(t, f"[^{profile.letters}]+", " "))


def minimal(col: Column | str) -> Column:
    """Light normalisation: links, mentions, ``#`` and emoji are deleted, alef forms folded."""
    t = F.replace(_without_links(_text(col), ""), F.lit("#"), F.lit(""))
    t = _unless_ascii(
        t, lambda x: F.regexp_replace(F.regexp_replace(x, MINIMAL_ALEF, ALEF), MINIMAL_SYMBOLS, "")
    )
    return F.array_join(words(t), " ")


def bag(col: Column | str, stop_words: Iterable[str] = ()) -> Column:
    """Bag-of-words normalisation: punctuation and marks deleted, letters folded, stop words
    dropped.  Stop words are compared with the *folded* words, so a stop word that itself
    holds a folded or deleted character never matches."""
    t = _swap(_text(col), BAG_FOLD_FROM, BAG_FOLD_TO, drop=BAG_PUNCTUATION + BAG_MARKS)
    kept, stop = words(t), sorted(set(stop_words))
    if stop:
        kept = F.filter(kept, lambda w: ~w.isin(stop))
    return F.array_join(kept, " ")


def raw(col: Column | str) -> Column:
    return _text(col)


def preprocess(
    col: Column | str,
    mode: str,
    profile: TextProfile = ARABIC,
    stop_words: Iterable[str] = (),
) -> Column:
    """The text a model sees under ``mode``: ``none``, ``minimal``, ``alg3`` or ``mhamed``."""
    if mode == "none":
        return raw(col)
    if mode == "minimal":
        return minimal(col)
    if mode == "alg3":
        return full(col, profile)
    if mode == "mhamed":
        return bag(col, stop_words)
    raise ValueError(f"unknown preprocessing mode: {mode}")


def nfkc(col: Column | str) -> Column:
    """Unicode NFKC.  Only texts that hold a character which may change leave the JVM, and only changed ones come back.

    A worker holds an Arrow batch (Spark bounds its bytes) and ``SLICE`` texts of it as Python strings."""

    @F.arrow_udf(StringType())
    def normalise(texts):
        import pyarrow as pa

        out = []
        for at in range(0, len(texts), SLICE):
            some = texts.slice(at, SLICE).to_pylist()
            out.append(pa.array([None if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)
                                 for t in some], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    t = _text(col)
    open_to_change = F.when((F.length(t) != F.octet_length(t)) & F.rlike(t, F.lit(MAY_CHANGE)), t)
    return F.coalesce(normalise(open_to_change), t)


def known(col: Column) -> Column:
    """Mark a value as never null.  Joins and aggregates on it then add no null filter, which
    Spark would push below the projection and pay for with a second normalisation."""
    return F.coalesce(col, F.lit(""))


def canonical_key(col: Column | str, profile: TextProfile = ARABIC) -> Column:
    """Key under which two texts count as the same text."""
    return _swap(full(nfkc(col), profile), profile.key_fold_from, profile.key_fold_to)


def text_id(col: Column | str, profile: TextProfile = ARABIC) -> Column:
    """Row and group id: SHA-256 (hex) of the canonical key."""
    return known(F.sha2(canonical_key(col, profile), 256))


def raw_hash(col: Column | str) -> Column:
    return known(F.sha2(_text(col), 256))
