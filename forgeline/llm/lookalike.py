"""Texts that look the same but consist of other characters (problem 8).

Every distinct text of an Arrow batch is brought to one form: compatibility normalisation to the composed form,
mapped white space, default-ignorable characters removed and look-alike letters folded to one script. Two profiles:

``look``  keeps what a reader sees apart (case, super- and subscripts, circled or styled letters); equal forms mean
          equal looks. This is the form by which pairs are found.
``fold``  is for loose comparison: full NFKC and full case folding on top.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from forgeline.session import materialize

# Letters of other scripts with the shape of a Latin letter or of a mark, in the order of the code points.
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "ι": "ı", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j"}
CYRILLIC = {
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "Ү": "Y", "ү": "y", "һ": "h", "Һ": "H", "Ӏ": "I", "ӏ": "l", "Ԁ": "D", "ԁ": "d", "Ԍ": "G", "ԛ": "q", "Ԛ": "Q", "ԝ": "w", "Ԝ": "W",
}
ARMENIAN = {"Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "օ": "o", "զ": "q"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B"}
LATIN = {"ɑ": "a", "ɡ": "g", "ǃ": "!", "ʼ": "'", "ˈ": "'"}
MARKS = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "⁃": "-", "∕": "/", "⁄": "/", "∶": ":", "꞉": ":", "׃": ":", "․": ".", "‚": ",", "∗": "*", "⁎": "*", "∼": "~", "˜": "~", "ǀ": "|", "∣": "|"}
# Compatibility kinds of the Unicode character data whose looks are the plain one.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
LIGATURES = range(0xFB00, 0xFB07)


def _ignorable(ch: str) -> bool:
    """Default-ignorable code points: format characters, variation selectors, fillers, tags and soft hyphens."""
    c = ord(ch)
    return (
        c in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0xFEFF)
        or 0x180B <= c <= 0x180F or 0x200B <= c <= 0x200F or 0x202A <= c <= 0x202E or 0x2060 <= c <= 0x206F or 0xFE00 <= c <= 0xFE0F or 0xE0000 <= c <= 0xE0FFF
        or unicodedata.category(ch) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2, 0x110BD)
        or unicodedata.category(ch) == "Cc" and ch not in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"
    )


@lru_cache(maxsize=1)
def look_table() -> dict[int, str]:
    """Maps for single characters, made from the Unicode character data and the fixed values above."""
    out: dict[int, str] = {}
    # all planes but ideographs, syllables, surrogates and private use, which have no entry
    for c in chain(range(0x20), range(0x7F, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0xE0000, 0xE1000)):
        ch = chr(c)
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if _ignorable(ch):
            out[c] = ""
        elif ch in "\n  \x85\v\f":
            out[c] = "\n"
        elif ch == "\r":
            continue
        elif ch.isspace():
            out[c] = " "
        elif kind in SAME_LOOK or c in LIGATURES or unicodedata.category(ch) == "Zs":
            out[c] = unicodedata.normalize("NFKC", ch)
    for group in (GREEK, CYRILLIC, ARMENIAN, CHEROKEE, LATIN, MARKS):
        out |= {ord(k): v for k, v in group.items() if k != v}
    return out


_LINE_END = re.compile("\r\n?")


def look_of(text: str) -> str:
    """The form of a text by its look. Composed letters are taken apart first, so that base letters of any script
    with an accent meet their plain twins, and put together again at the end."""
    if text.isascii() and "\r" not in text and "\t" not in text and text.isprintable():
        return text
    apart = unicodedata.normalize("NFD", _LINE_END.sub("\n", text)).translate(look_table())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", apart).translate(look_table()))


def folded(text: str) -> str:
    """The form for loose comparison: NFKC, full case folding and single blanks over the look."""
    once = unicodedata.normalize("NFKC", look_of(unicodedata.normalize("NFKC", text)).casefold())
    return re.sub(r"[ \n]+", " ", once).strip(" ")


def _per_distinct(fn):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        distinct = texts.dropna().unique()
        return texts.map(dict(zip(distinct, map(fn, distinct))))

    return run


def consistent_text(df: DataFrame, text: str = "text", out: str = "text_form", profile: str = "look") -> DataFrame:
    """``df`` with the consistent form of ``text`` in ``out`` (which replaces a column of that name).

    Null stays null and an empty text empty; a text of ignorable characters only becomes empty.
    """
    fn = {"look": look_of, "fold": folded}[profile]
    return df.withColumn(out, _per_distinct(fn)(F.col(text)))


def lookalike_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All pairs ``doc_id_a < doc_id_b`` of different texts with one look.

    Only 128-bit digests of text and form are shuffled. Forms with a single distinct text, which are nearly all,
    drop out before any pair is made. Pairs are made of texts and then carried over to their documents, so a text with
    very many copies costs no more than the rows it gives. Null ids, null texts and
    empty texts are in no pair; a repeated row counts once; a text that only looks empty is compared like any other.
    """
    rows = (
        df.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter(F.col("d").isNotNull() & (F.length("t") > 0))
        .withColumn("form", _per_distinct(look_of)(F.col("t")))
        .select("d", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("t")).alias("own"))
    )
    rows = materialize(rows, "forms")  # read twice below
    # the least and the greatest digest tell whether a form has more than one text, by a map-side aggregate
    several = rows.groupBy("form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter(F.col("lo") != F.col("hi")).select("form")
    kept = materialize(rows.join(several, "form", "left_semi").distinct(), "kept")
    # pairs of different texts first, then the documents of either text: no two copies of a text ever meet
    texts = kept.select("form", "own").distinct()
    unlike = texts.join(texts.select("form", F.col("own").alias("own2")), "form").filter(F.col("own") < F.col("own2")).select("own", "own2")
    first = unlike.join(kept.select("own", "d"), "own").select("own2", "d")
    both = first.join(kept.select(F.col("own").alias("own2"), F.col("d").alias("d2")), "own2").filter(F.col("d") != F.col("d2"))
    return both.select(F.least("d", "d2").alias("doc_id_a"), F.greatest("d", "d2").alias("doc_id_b"))
