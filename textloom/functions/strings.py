"""String functions as column expressions; Python only where a rule is sequential (stemming, weighted edit distance)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, StringType

NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion").split()
#: Segmenters by name: the pattern whose matches are the segments.
SEGMENTS = {
    "alpha": r"\p{L}+",
    "ascii_alpha": r"[A-Za-z]+",
    "word": r"\w+",
    "word_classes": r"\p{L}+|\p{N}+|[\p{P}\p{S}]+",
    "non_space": r"\S+",
    "non_space_classes": r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]",
    "foreign_word": r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*",
    "url": r"[^/.?=&:#]+",
    "csv": r"[^,\n]+",
}
CHINESE = {
    "end_of_sentence": "[。！？；…!?]",
    "white_space": "[\\s　 ]",
    "punctuation": "[、-〃〈-】〔-〟！-／：-＠［-｀｛-･\\p{P}]",
    "numeric": "[0-9０-９]",
    "chinese_numeral": "[零〇一二三四五六七八九十百千万亿]",
    "alpha": "[A-Za-zＡ-Ｚａ-ｚ]",
}


def segment(text: Column, kind: str = "ascii_alpha") -> Column:
    """All segments of a text, as an array; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SEGMENTS[kind]), F.lit(0)), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """The JDK's locale-aware word breaks within sentence breaks."""
    return F.sentences(text)


def chinese_all(text: Column, kind: str) -> Column:
    return text.rlike(f"^{CHINESE[kind]}+$")


def chinese_any(text: Column, kind: str) -> Column:
    return text.rlike(CHINESE[kind])


def shape(word: Column, longest: int = 2) -> Column:
    """Letters become A or a, digits 1, spaces one space; runs of a class are cut to `longest`."""
    out = word
    for pattern, mark in ((r"\p{Lu}", "\x01"), (r"\p{Ll}", "\x02"), (r"\p{Nd}", "\x03"), (r"\s", "\x04")):
        out = F.regexp_replace(out, pattern, mark)
    out = F.translate(F.regexp_replace(out, r"([\x01-\x04])\1{%d,}" % longest, "$1" * longest), "\x01\x02\x03\x04", "Aa1 ")
    # most words are of two simple kinds, told by one pattern each; marks alone stay
    run = F.lit("a" * longest)
    return F.when(word.rlike("^[a-z]+$"), F.left(run, F.length(word))).when(word.rlike("^[A-Z][a-z]+$"), F.concat(F.lit("A"), F.left(run, F.length(word) - 1))).when(word.rlike(r"^[!-/:-@\[-`{-~]+$"), word).otherwise(out)


def affix_ngrams(word: Column, least: int, most: int) -> Column:
    """Prefixes and suffixes of `<word>` of least to most characters, shorter first, those of a size together."""
    whole = F.concat(F.lit("<"), word, F.lit(">"))
    sizes = F.sequence(F.lit(least), F.lit(most))
    both = F.flatten(F.transform(sizes, lambda n: F.when(n < F.length(whole), F.array(F.substring(whole, F.lit(1), n), F.substring(whole, F.length(whole) - n + 1, n))).otherwise(F.array().cast("array<string>"))))
    return both


def is_year(word: Column) -> Column:
    return word.rlike(r"^(?:19|20)[0-9]{2}$")


def is_number(word: Column) -> Column:
    return word.rlike(r"^[0-9]+$") | F.lower(word).isin(*NUMBER_WORDS)


def collapse_digits(word: Column) -> Column:
    return F.when(F.lower(word).isin(*NUMBER_WORDS) | word.rlike("[0-9]"), F.lit("0")).otherwise(word)


def replace_digits(word: Column) -> Column:
    return F.when(F.lower(word).isin(*NUMBER_WORDS), F.lit("<NUM>")).otherwise(F.regexp_replace(word, "[0-9]+", "0"))


def simplify_digits(word: Column) -> Column:
    """<YEAR> for 19xx and 20xx, <NUM> for other digits, # for each digit elsewhere."""
    return F.when(is_year(word), F.lit("<YEAR>")).when(word.rlike("^[0-9]+$"), F.lit("<NUM>")).otherwise(F.regexp_replace(word, "[0-9]", "#"))


def strip_accents(text: Column) -> Column:
    return F.translate(text, "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def strip_punctuation(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def to_int_safe(text: Column) -> Column:
    return text.try_cast("int")


def to_double_safe(text: Column) -> Column:
    return text.try_cast("double")


TOKEN_TESTS = {
    "capitalised": r"^\p{Lu}",
    "lower": r"^\p{Ll}+$",
    "upper": r"^\p{Lu}+$",
    "has_lower": r"\p{Ll}",
    "digits": r"^\p{Nd}+$",
    "has_digit": r"\p{Nd}",
    "punctuation": r"^[\p{P}\p{S}]+$",
    "contraction": r"^['’](?:s|t|re|ve|m|ll|d)$",
    "initial": r"^\p{Lu}\.$",
}


def token_is(word: Column, test: str) -> Column:
    return word.rlike(TOKEN_TESTS[test])


def edit_distance(a: str, b: str, change: int = 1, drop: int = 1, add: int = 1) -> int:
    """Weighted Levenshtein distance from a to b."""
    row = [j * add for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i * drop
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (0 if x == y else change), row[j] + drop, row[j - 1] + add)
    return row[-1]


def weighted_edit_distance(a: Column, b: Column, change: int = 1, drop: int = 1, add: int = 1) -> Column:
    """The JVM's levenshtein for unit weights, an Arrow-batched function for others."""
    if change == drop == add == 1:
        return F.levenshtein(a, b)

    @F.pandas_udf(IntegerType())
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(p, q, change, drop, add) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return distance(a, b)


_VOWELS = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWELS if c != "y" else i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds) - 1))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(w: str) -> str:
    """Porter's stemmer of 1980 for one lower-case word."""
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut is not None:
            w = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if _double(cut) and cut[-1] not in "lsz" else cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                w = w[: -len(s)] + table[s] if _measure(w[: -len(s)]) > 0 else w
                break
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    known = {w: porter(w) for w in words.dropna().unique()}
    return words.map(known)
