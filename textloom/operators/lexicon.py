"""Lexicons of phrases: word lists, membership, and tagging of token rows."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.strings import NUMBER_WORDS

WORD_LISTS = {
    "number": tuple(NUMBER_WORDS),
    "determiner": ("the", "a", "an", "this", "that", "these", "those", "each", "every", "either", "neither", "some", "any", "no", "all", "both"),
    "pronoun": ("i", "me", "you", "he", "him", "she", "her", "it", "we", "us", "they", "them", "who", "whom", "myself", "yourself", "himself", "herself", "itself", "ourselves", "themselves"),
    "possessive": ("my", "mine", "your", "yours", "his", "hers", "its", "our", "ours", "their", "theirs", "whose"),
    "preposition": ("about", "above", "across", "after", "against", "along", "among", "around", "at", "before", "behind", "below", "beneath", "beside", "between", "beyond", "by", "down", "during", "except", "for", "from", "in", "inside", "into", "near", "of", "off", "on", "onto", "out", "outside", "over", "past", "since", "through", "to", "toward", "under", "until", "up", "upon", "with", "within", "without"),
}
WORD_LISTS["stop"] = tuple(sorted({*WORD_LISTS["determiner"], *WORD_LISTS["pronoun"], *WORD_LISTS["possessive"], *WORD_LISTS["preposition"], "and", "or", "but", "if", "then", "than", "so", "as", "is", "am", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "can", "could", "shall", "should", "may", "might", "must", "not"}))


def word_list(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in WORD_LISTS[name]], "phrase string")


def normal_phrase(column):
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def contains(rows: DataFrame, column: str, lexicon: DataFrame, into: str) -> DataFrame:
    """Adds whether a phrase is in the lexicon; its size decides how Spark joins."""
    known = lexicon.select(normal_phrase(F.col("phrase")).alias("_p"), F.lit(True).alias("_k")).distinct()
    return rows.withColumn("_p", normal_phrase(F.col(column))).join(known, "_p", "left").withColumn(into, F.coalesce("_k", F.lit(False))).drop("_p", "_k")


class PhraseAutomaton:
    """Finds all phrases in a sequence of words in one pass: a trie with failure links."""

    def __init__(self, phrases):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.ends = [0], [[]]
        for p in phrases:
            at, words = 0, p.lower().split()
            for w in words:
                if w not in self.next[at]:
                    self.next[at][w] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append([])
                at = self.next[at][w]
            if words and len(words) not in self.ends[at]:
                self.ends[at].append(len(words))
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for w, child in self.next[node].items():
                f = self.fail[node]
                while f and w not in self.next[f]:
                    f = self.fail[f]
                self.fail[child] = self.next[f].get(w, 0) if self.next[f].get(w, 0) != child else 0
                self.ends[child] = sorted({*self.ends[child], *self.ends[self.fail[child]]})
                queue.append(child)

    def find(self, words) -> list[tuple[int, int]]:
        """(first, length) of every occurrence, nested and overlapping ones included."""
        at, out = 0, []
        for i, w in enumerate(words):
            w = w.lower()
            while at and w not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(w, 0)
            out += [(i - n + 1, n) for n in self.ends[at]]
        return sorted(out)

    def tag(self, words) -> list[str]:
        """BILOU marks of the longest phrases from the left."""
        marks, taken = ["O"] * len(words), 0
        for first, n in sorted(self.find(words), key=lambda x: (x[0], -x[1])):
            if first >= taken:
                marks[first : first + n] = ["U"] if n == 1 else ["B", *["I"] * (n - 2), "L"]
                taken = first + n
        return marks


def tag_phrases(sentences: DataFrame, phrases: list[str], into: str = "marks") -> DataFrame:
    """Adds marks to rows with words, by an automaton that is shipped to the tasks; for lexicons too large for that, match_phrases
    in operators.relations joins n-grams."""
    shared = sentences.sparkSession.sparkContext.broadcast(PhraseAutomaton(phrases))

    def run(batches):
        a = shared.value
        for pdf in batches:
            yield pdf.assign(**{into: [a.tag(list(w)) if w is not None else None for w in pdf["words"]]})

    return sentences.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema) + f", {into} array<string>")


def suffix_table(phrases: list[str]) -> pd.DataFrame:
    """All word suffixes of phrases with the phrases that they end, for lookups of partial names."""
    rows = [(" ".join(w[i:]), p) for p in phrases for w in [p.lower().split()] for i in range(len(w))]
    return pd.DataFrame(rows, columns=["suffix", "phrase"])
