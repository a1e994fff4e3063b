"""Tokens, their normal forms, and sentences of running text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St Rev Gen Sen Rep Gov Capt Lt Col Sgt Inc Ltd Co Corp Bros Dept Univ Assn vs etc e.g i.e al Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun No Fig Vol pp ed eds cf approx".split()
_SHORT = "|".join(re.escape(a) for a in sorted(_ABBREVIATIONS, key=len, reverse=True))
#: What a token may be; the first that matches at a place wins.
TOKEN = re.compile(
    "|".join(
        (
            r"(?P<space>\s+)",
            r"[^\W\d_]+(?=[\s,;])",  # most words; nothing longer begins so
            r"[,;](?=\s)",
            r"</?[A-Za-z][^<>]{0,200}>",  # markup
            r"&(?:[A-Za-z]{2,8}|#\d{2,6});",  # entities
            r"(?:https?|ftp)://[^\s<>\"]+[^\s<>\".,;:!?)\]]",
            r"www\.[^\s<>\"]+[^\s<>\".,;:!?)\]]",
            r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
            r"(?<!\w)[@#]\w+",
            r"(?<!\d)(?:\+?\d{1,2}[ .-])?\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\d)",  # telephone
            r"(?<!\d)\d{1,4}[-/]\d{1,2}[-/]\d{1,4}(?!\d)",  # dates
            r"(?:19|20)?\d0['’]?s\b",  # decades
            r"\d+(?:st|nd|rd|th)\b",
            r"(?:US|C|A|HK)?[$£€¥](?=\d)",
            r"\d{1,3}(?:,\d{3})+(?:\.\d+)?",
            r"\d+/\d+(?!\d)",
            r"\d*\.?\d+(?!\w)",
            r"[:;=8][-o]?[)(\]\[dDpP/\\|](?!\w)",  # faces
            rf"\b(?:{_SHORT})\.",
            r"(?:[A-Za-z]\.){2,}",
            r"\b[A-Z]\.(?=\s)",
            r"(?:ca(?=n['’]t)|wo(?=n['’]t)|sha(?=n['’]t)|[^\W\d_]+?(?=n['’]t\b))",
            r"n['’]t\b",
            r"['’](?:s|S|re|ve|ll|d|m)\b",
            r"[\w-]+\.(?:html?|txt|pdf|docx?|xml|csv|jpe?g|png|gif|zip|exe|com|org|net|edu|gov)\b",
            r"[^\W_]+(?:[-'’](?!s\b|re\b|ve\b|ll\b|d\b|m\b|t\b)[^\W_]+)*",
            r"\.{2,}|…",
            r"-{2,}|–|—",
            r"``|''|[“”„«»\"]",
            r"[!?]+",
            r"[^\w\s]|_+",
        )
    )
)
TOKENS = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("string", StringType())])


def tokenize(text: str | None, markup: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, string); markup is skipped unless asked for."""
    found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text or "") if m.lastgroup is None]
    return found if markup else [t for t in found if t[2][0] != "<" or len(t[2]) == 1]


@F.pandas_udf(ArrayType(TOKENS))
def token_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "string": s} for a, b, s in tokenize(t)])


def _kind(t: str) -> int:
    """0 a lower-case word, 1 another word or number, 2 closing punctuation, 3 what may close after it, 4 anything else."""
    c = t[0]
    if "a" <= c <= "z" or c > "\x7f" and unicodedata.category(c) == "Ll":
        return 0
    if c.isascii() and c.isalnum() or c > "\x7f" and unicodedata.category(c)[0] in "LN":
        return 1
    if c in ".!?" and not t.strip(".!?") or t == "…":
        return 2
    return 3 if not t.strip("\"”’')]") else 4


def sentence_numbers(found: list[tuple[int, int, str]]) -> list[int]:
    """The sentence of each token of a text, by the rule of sentences_of()."""
    out, sent, b, b2, last = [], 0, 4, 4, None
    for start, end, string in found:
        k = _kind(string)
        closed = b == 2 or b == 3 and b2 == 2
        if last is not None and (closed and k not in (0, 2, 3) or start - last > 10):
            sent += 1
        out.append(sent)
        b, b2, last = k, b, end
    return out


def tokens_of(docs: DataFrame, text: str = "text", sentences: bool = False) -> DataFrame:
    """The other columns of docs, then pos, start, end, string, a row per token: every string is the text between its offsets.
    With `sentences` also sent, the sentence's number, found where the text is cut, so that no token is shuffled for it.

    Tokens go to Spark as flat Arrow columns; the other columns are repeated by index."""
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                row, pos, start, end, string, sent = [], [], [], [], [], []
                for r, t in enumerate(part.column(text).to_pylist()):
                    found = tokenize(t)
                    row += [r] * len(found)
                    pos += range(len(found))
                    if found:
                        a, z, w = zip(*found, strict=True)
                        start += a
                        end += z
                        string += w
                        if sentences:
                            sent += sentence_numbers(found)
                index = pa.array(row, pa.int32())
                cols = [part.column(c).take(index) for c in keep]
                cols += [pa.array(pos, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(string, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(sent, pa.int32())] * sentences, names=[*keep, "pos", "start", "end", "string"] + ["sent"] * sentences)

    schema = StructType([*(docs.schema[c] for c in keep), StructField("pos", IntegerType()), *TOKENS.fields, *[StructField("sent", IntegerType())] * sentences])
    return docs.select(*keep, text).mapInArrow(run, schema)


_PLAIN = (
    (r"^(?:\"|“|„|«|``)$", '"'),
    (r"^(?:”|»|'')$", '"'),
    (r"[‘’`´]", "'"),
    (r"^(?:US|C|A|HK)?[$£€¥]$", "$"),
    (r"^&amp;$", "&"),
    (r"^(?:\.{2,}|…)$", "..."),
    (r"^(?:-{2,}|–|—)$", "--"),
    ("½", "1/2"),
    ("¼", "1/4"),
    ("¾", "3/4"),
    (r"^-LRB-$", "("),
    (r"^-RRB-$", ")"),
    (r"\\/", "/"),
)


def normal_form(token: Column) -> Column:
    out = token
    for pattern, plain in _PLAIN:
        out = F.regexp_replace(out, pattern, plain.replace("$", "\\$"))
    # what no pattern finds stays as it is: told by one pattern, after plain words, which hold nothing that any finds
    same = token.rlike(r"^[\p{L}0-9]+$") | ~token.rlike("|".join(pattern for pattern, _ in _PLAIN))
    return F.when(same, token).otherwise(out)


def sentences_of(toks: DataFrame) -> DataFrame:
    """Adds sent: a sentence ends at closing punctuation with what closes after it, or at an empty line between tokens.

    toks has (doc_id, pos, start, end, string) and gap, the text's line ends before the token, if known."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = F.col("string")
    # one small number per token, so that each pattern is tried once
    kind = F.when(t.rlike(r"^\p{Ll}"), 0).when(t.rlike(r"^[\p{L}\p{N}]"), 1).when(t.rlike(r"^(?:[.!?]+|…)$"), 2).when(t.rlike(r"^[\"”’')\]]+$"), 3).otherwise(4)
    toks = toks.withColumn("_k", kind).withColumn("_b", F.lag("_k").over(w)).withColumn("_b2", F.lag("_k", 2).over(w))
    far = F.coalesce(F.col("start") - F.lag("end").over(w) > 10, F.lit(False))
    closed = (F.col("_b") == 2) | ((F.col("_b") == 3) & (F.coalesce("_b2", F.lit(4)) == 2))
    goes_on = F.col("_k").isin(0, 2, 3)
    toks = toks.withColumn("_new", ((F.coalesce(closed, F.lit(False)) & ~goes_on) | far).cast("int"))
    return toks.withColumn("sent", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_k", "_b", "_b2")


def dehyphenate(toks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Joins `a - b` if ab is in the dictionary (phrase) or a word of the same document."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = toks.withColumn("_n1", F.lead("string").over(w)).withColumn("_n2", F.lead("string", 2).over(w)).withColumn("_e2", F.lead("end", 2).over(w))
    x = x.withColumn("_j", F.when(F.col("_n1") == "-", F.lower(F.concat("string", "_n2"))))
    known = toks.select("doc_id", F.lower("string").alias("_j")).distinct().withColumn("_own", F.lit(True))
    x = x.join(known, ["doc_id", "_j"], "left").join(dictionary.select(F.col("phrase").alias("_j"), F.lit(True).alias("_dict")).distinct(), "_j", "left")
    x = x.withColumn("_joins", F.coalesce("_own", "_dict", F.lit(False)) & F.col("_j").isNotNull())
    gone = F.coalesce(F.lag("_joins", 1).over(w), F.lit(False)) | F.coalesce(F.lag("_joins", 2).over(w), F.lit(False))
    x = x.withColumn("_gone", gone).where("not _gone")
    return x.select("doc_id", "pos", "start", F.when(F.col("_joins"), F.col("_e2")).otherwise(F.col("end")).alias("end"), F.when(F.col("_joins"), F.concat("string", "_n2")).otherwise(F.col("string")).alias("string"))


def merge_phrases(words: list[str], phrases: set[tuple[str, ...]], longest: int, joint: str = " ") -> list[str]:
    """Left to right, the longest phrase that begins at each place becomes one token."""
    out, i = [], 0
    while i < len(words):
        n = next((k for k in range(min(longest, len(words) - i), 1, -1) if tuple(w.lower() for w in words[i : i + k]) in phrases), 1)
        out.append(joint.join(words[i : i + n]))
        i += n
    return out


def with_phrases(docs: DataFrame, phrases: list[str], column: str = "words") -> DataFrame:
    """Replaces an array of words by one with phrases merged; the list of phrases is shipped with the function."""
    known = {tuple(p.lower().split()) for p in phrases}
    longest = max(map(len, known), default=1)

    @F.pandas_udf(ArrayType(StringType()))
    def merge(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: merge_phrases(list(r), known, longest) if r is not None else None)

    return docs.withColumn(column, merge(column))


def log_likelihood(n: Column, n_dot: Column, n_word: Column, n_both: Column) -> Column:
    """Dunning's ratio for how far a word goes with a full stop: n tokens, n_dot stops, n_word of the word, n_both together."""
    def ll(k, m, p):
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (m - k) * F.log(1 - p)

    p, p1, p2 = n_dot / n, n_both / n_word, (n_dot - n_both) / (n - n_word)
    return 2 * (ll(n_both, n_word, p1) + ll(n_dot - n_both, n - n_word, p2) - ll(n_both, n_word, p) - ll(n_dot - n_both, n - n_word, p))


def abbreviation_scores(toks: DataFrame) -> DataFrame:
    """(word, score) for unsupervised sentence training: how strongly each word form, without its stop, goes with one.

    toks is (string) of tokens split at white space, a row each, or with `uses` a row for so many; short words and inner stops count for,
    stopless uses against."""
    uses = F.col("uses") if "uses" in toks.columns else F.lit(1).cast("long")
    words = toks.select(F.lower(F.regexp_replace("string", r"\.$", "")).alias("word"), F.col("string").endswith(".").cast("int").alias("dot"), uses.alias("uses")).where(F.col("word").rlike(r"\p{L}"))
    per = words.groupBy("word").agg(F.sum("uses").alias("n"), F.sum(F.col("dot") * F.col("uses")).alias("d"))
    whole = per.agg(F.sum("n").alias("all"), F.sum("d").alias("dots"))
    x = per.join(F.broadcast(whole)).where("d > 0 and n < all")  # one row
    ratio = F.when((F.col("dots") > 0) & (F.col("dots") < F.col("all")), log_likelihood(F.col("all"), F.col("dots"), F.col("n"), F.col("d"))).otherwise(0.0)
    size = F.length(F.regexp_replace("word", r"\.", ""))
    inner = F.length("word") - size + 1
    against = F.pow(size.cast("double"), -(F.col("n") - F.col("d")).cast("double"))
    return x.select("word", "n", "d", (ratio * F.exp(-size.cast("double")) * inner * against).alias("score"))

