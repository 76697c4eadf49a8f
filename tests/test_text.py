"""Normalisation: hand-worked cases for every trap, and properties over random texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from labelloom.functions import text as T


def apply(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


FULL = {
    # links, mentions and hashtags (text kept), marks, folds, tatweel, long runs, Latin, digits
    "شوف https://a.b/c?d=1 الخبر": "شوف الخبر",
    "www.site.org/ه كلام": "كلام",
    "قال @user_1 كلام @أحمد زين": "قال كلام زين",
    "#الخرطوم_اليوم": "الخرطوم اليوم",
    "كَتَبَ": "كتب",
    "أإآٱ": "ا",                                      # four alef forms become a run of four
    "مدرسةى": "مدرسهي",
    "كـــتاب": "كتاب",
    "جمييييل جداا": "جميل جداا",                      # runs above two shrink, pairs stay
    "سلام ok 123 !! _ سلام": "سلام سلام",
    "كلام😀😀كلام": "كلام كلام",
    "سلام عليكم يا\x1cناس": "سلام عليكم يا ناس",
    "http://كلام　باقي": "باقي",                  # an ideographic blank ends a link
    "ا😀اا": "ا اا",                                   # a symbol separates runs
    "": "",
    None: "",
}


def test_full_hand_worked(spark):
    got = apply(spark, list(FULL), T.full(F.col("t")))
    assert [g[0] for g in got] == list(FULL.values())


MINIMAL = {
    "a https://x.y b": "a b",
    "a @name,b": "a ,b",
    "#tag": "tag",
    "إسلام أكل آمن ٱ": "اسلام اكل امن ٱ",            # the fourth alef form stays here
    "مدرسة ى": "مدرسة ى",
    "a😀b": "ab",                                       # deleted, no space
    "a漢字b": "ab",                                      # the wide range deletes most CJK
    "  a \t\n b c ": "a b c",
    "❤️ ok": "️ ok" if False else "ok",
    None: "",
}


def test_minimal_hand_worked(spark):
    got = [g[0] for g in apply(spark, list(MINIMAL), T.minimal(F.col("t")))]
    assert got == list(MINIMAL.values())


def test_bag_deletes_punctuation_folds_and_drops_stop_words(spark):
    texts = ["a,b c.d", "هذا كتابٌ جميل", "أكل إلى مدرسة", "مسؤول رئيس گال", "the cat the hat", None]
    stop = ["the", "هذا", "إلى"]
    got = [g[0] for g in apply(spark, texts, T.bag(F.col("t"), stop))]
    # "إلى" folds to "الي" before the comparison, so that stop word can never match.
    assert got == ["ab cd", "كتاب جميل", "اكل الي مدرسه", "مسءول رءيس كال", "cat hat", ""]


def test_mention_ends_at_a_combining_mark(spark):
    got = apply(spark, ["@أَحمد"], T.full(F.col("t")))
    assert got == [("حمد",)]


def test_key_merges_variants_and_is_idempotent(spark):
    variants = ["السلامُ عليكم", "السـلام   عليكم!!", "السلام، عليكم 🙏", "اﻟﺴﻼم عليكم", "السلام علیکم"]
    ids = {r[0] for r in apply(spark, variants, T.text_id(F.col("t")))}
    assert len(ids) == 1
    once = T.full(F.col("t"))
    for a, b in apply(spark, list(FULL), once, T.full(once)):
        assert a == b


def test_modes_are_total_and_unknown_mode_fails(spark):
    for m in ("none", "minimal", "alg3", "mhamed"):
        got = apply(spark, ["مرحبا", None, ""], T.preprocess(F.col("t"), m))
        assert all(isinstance(g[0], str) for g in got)
    with pytest.raises(ValueError):
        T.preprocess(F.col("t"), "other")


def test_random_texts_keep_the_invariants(spark):
    rng = random.Random(7)
    alphabet = [chr(c) for c in (*range(0x20, 0x7F), *range(0x0600, 0x0700), 0x1F600, 0x2603, 0x200D, 0x2028, 0x85, 0x1C)]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    keep = {chr(c) for lo, hi in ((0x621, 0x63A), (0x641, 0x64A), (0x671, 0x6D3)) for c in range(lo, hi + 1)}
    folded = set("آأإٱىئةـ")
    for full, minimal, norm, n in apply(
        spark, texts, T.full(F.col("t")), T.minimal(F.col("t")), T.nfkc(F.col("t")), T.word_count(F.col("t"))
    ):
        assert set(full) <= (keep - folded) | {" "} and full == " ".join(full.split())
        assert not any(full[i] == full[i + 1] == full[i + 2] for i in range(len(full) - 2))
        assert minimal == " ".join(minimal.split()) and "#" not in minimal
    counts = [r[0] for r in apply(spark, texts, T.word_count(F.col("t")))]
    assert counts == [len(t.split()) for t in texts]
    norms = [r[0] for r in apply(spark, texts, T.nfkc(F.col("t")))]
    assert norms == [unicodedata.normalize("NFKC", t) for t in texts]


def test_only_texts_that_nfkc_may_change_reach_python(spark):
    """Stable characters stay as they are wherever they stand; everything else equals the library, slice by slice."""
    ranges = [(int(a, 16), int(b, 16)) for a, b in re.findall(
        r"\\x\{?([0-9a-f]+)\}?-\\x\{?([0-9a-f]+)\}?", T.STABLE)]
    second = {unicodedata.normalize("NFD", c)[1:] for c in map(chr, range(0x110000))
              if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.is_normalized("NFC", c)}
    second = set("".join(second)) | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    stable = [chr(i) for a, b in ranges for i in range(a, b + 1)]
    assert len(ranges) == 11 and not [c for c in stable if not unicodedata.is_normalized("NFKC", c) or c in second]
    assert not [c for c in stable if unicodedata.combining(c) and unicodedata.category(c)[0] != "M"]
    r = random.Random(3)
    odd = ["e\u0301", "\u0650\u0651", "\u0651\u0650", "\ufb01", "\u1100\u1161\u11a8", "\u0627\u0653", "x\u0327\u0301", "\u2126", "\U0001d400"]
    rows = [(i, "".join(r.choice(odd if r.random() < 0.2 else stable) for _ in range(r.randint(0, 6))).replace("\x00", "")) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None), (301, "\u0628" * 9)], "i int, t string")
    got = {x.i: x.n for x in df.select("i", T.nfkc("t").alias("n")).collect()}
    assert got == {i: unicodedata.normalize("NFKC", t) for i, t in rows} | {300: "", 301: "\u0628" * 9}
    sent = [i for i, t in rows if not unicodedata.is_normalized("NFKC", t)]
    may = {x.i for x in df.where(F.rlike("t", F.lit(T.MAY_CHANGE))).collect()}
    assert set(sent) <= may and len(may) < 250 and 301 not in may
