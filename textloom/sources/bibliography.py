"""BibTeX entries and person names."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

PREFIXES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "rev", "sir", "hon", "lord", "lady"}
HEIRS = {"jr", "sr", "ii", "iii", "iv", "v"}
DEGREES = {"phd", "md", "ba", "bs", "ma", "ms", "msc", "bsc", "mba", "jd", "dds", "esq", "llb"}
PARTICLES = {"von", "van", "de", "der", "den", "del", "della", "di", "da", "la", "le", "du", "dos", "bin", "ibn", "al", "el", "ter", "ten"}


@dataclass
class PersonName:
    prefixes: list[str] = field(default_factory=list)
    given: list[str] = field(default_factory=list)
    nicknames: list[str] = field(default_factory=list)
    surname: str = ""
    heredity: str = ""
    degrees: list[str] = field(default_factory=list)

    def canonical(self) -> str:
        return " ".join(x for x in [*self.given, self.surname, self.heredity] if x)


def _bare(word: str) -> str:
    return word.lower().replace(".", "").strip(",")


def parse_name(text: str | None) -> PersonName | None:
    """`Prefix Given (Nick) particle Surname Jr, PhD`, or `Surname, Given` with the same additions."""
    if not text or not text.strip():
        return None
    out = PersonName(nicknames=re.findall(r"[\"(“]([^\")”]+)[\")”]", text))
    parts = [p.strip() for p in re.sub(r"[\"(“][^\")”]+[\")”]", " ", text).split(",")]
    while len(parts) > 1 and all(_bare(w) in DEGREES | HEIRS for w in parts[-1].split()):
        for w in parts.pop().split():
            if _bare(w) in HEIRS:
                out.heredity = w
            else:
                out.degrees.append(w)
    reverse = len(parts) > 1
    words = (parts[1] if reverse else parts[0]).split()
    while words and _bare(words[0]) in PREFIXES:
        out.prefixes.append(words.pop(0))
    while len(words) > 1 and _bare(words[-1]) in HEIRS | DEGREES:
        w = words.pop()
        if _bare(w) in HEIRS:
            out.heredity = w
        else:
            out.degrees.insert(0, w)
    if reverse:
        last = parts[0].split()
        if len(last) > 1 and _bare(last[-1]) in HEIRS:
            out.heredity = last.pop()
        out.surname, out.given = " ".join(last), words
        return out
    at = next((i for i, w in enumerate(words[:-1]) if i and _bare(w) in PARTICLES), len(words) - 1)
    out.given, out.surname = words[:at], " ".join(words[at:])
    return out


def compatible(a: PersonName, b: PersonName) -> bool:
    """Equal surnames and no given name that contradicts another: an initial goes with what it begins."""
    if _bare(a.surname) != _bare(b.surname) or a.heredity and b.heredity and _bare(a.heredity) != _bare(b.heredity):
        return False
    for x, y in zip(map(_bare, a.given), map(_bare, b.given)):
        short, long = sorted((x, y), key=len)
        if not (long.startswith(short) if len(short) == 1 else short == long):
            return False
    return True


def merge_names(a: PersonName, b: PersonName) -> PersonName:
    """The fuller of each part."""
    given = [max(x, y, key=lambda s: len(_bare(s))) for x, y in zip(a.given, b.given)]
    given += (a.given if len(a.given) > len(b.given) else b.given)[len(given) :]
    return PersonName(a.prefixes or b.prefixes, given, list(dict.fromkeys([*a.nicknames, *b.nicknames])), max(a.surname, b.surname, key=len), a.heredity or b.heredity, list(dict.fromkeys([*a.degrees, *b.degrees])))


def author_canopy(name: PersonName) -> str:
    """First initial and the longest word of the surname."""
    words = name.surname.split() or [""]
    return (_bare(name.given[0])[:1] if name.given else "") + _bare(max(words, key=len))


NAME = "struct<prefixes:array<string>,given:array<string>,nicknames:array<string>,surname:string,heredity:string,degrees:array<string>,canopy:string>"


def with_names(df: DataFrame, column: str, into: str = "parsed") -> DataFrame:
    """Adds the parsed name, worked out once per distinct string of a batch."""

    def run(batches):
        for pdf in batches:
            known = {}
            for x in pdf[column].dropna().unique():
                n = parse_name(x)
                known[x] = None if n is None else {**n.__dict__, "canopy": author_canopy(n)}
            yield pdf.assign(**{into: pdf[column].map(known)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {into} {NAME}"
    return df.mapInPandas(run, schema)


def parse_bibtex(text: str) -> list[dict]:
    """Entries as {type, key, fields}; @string abbreviations are replaced, # joins, braces nest, comments go."""
    out, short, at = [], {m: m for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()}, 0

    def closing(i: int, opened: str) -> int:
        depth, shut = 0, {"{": "}", "(": ")"}[opened]
        while i < len(text):
            if text[i] == "\\":
                i += 1
            elif text[i] == opened:
                depth += 1
            elif text[i] == shut:
                depth -= 1
                if not depth:
                    return i
            i += 1
        return len(text)

    for m in iter(lambda: re.compile(r"@\s*([A-Za-z]+)\s*([{(])").search(text, at), None):
        end = closing(m.end() - 1, m[2])
        kind, body = m[1].lower(), text[m.end() : end]
        at = end + 1
        if kind in ("comment", "preamble"):
            continue
        key = ""
        if kind != "string":
            key, _, body = body.partition(",")
        fields = {}
        for name, value in _fields(body):
            fields[name.lower()] = "".join(short.get(v.lower(), v) if raw else v for v, raw in value)
        if kind == "string":
            short |= {k.lower(): v for k, v in fields.items()}
        else:
            out.append({"type": kind, "key": key.strip(), "fields": fields})
    return out


def _fields(body: str):
    i = 0
    while m := re.compile(r"\s*,?\s*([^\s=,{}\"#]+)\s*=\s*").match(body, i):
        i, parts = m.end(), []
        while i < len(body):
            if body[i] in "{\"":
                j, depth, quote = i + 1, 1, body[i] == '"'
                while j < len(body) and depth:
                    if body[j] == "\\":
                        j += 1
                    elif quote and body[j] == '"' and depth == 1 or not quote and body[j] == "}" or quote and body[j] == "}" and depth > 1:
                        depth -= 1
                    elif body[j] == "{":
                        depth += 1
                    j += 1
                parts.append((re.sub(r"\s+", " ", body[i + 1 : j - 1]), False))
                i = j
            elif raw := re.compile(r"[^\s,#}]+").match(body, i):
                parts.append((raw[0], True))
                i = raw.end()
            if more := re.compile(r"\s*#\s*").match(body, i):
                i = more.end()
            else:
                break
        yield m[1], parts


def bibtex_entries(files: DataFrame, column: str = "text") -> DataFrame:
    """(type, key, fields, authors) of all entries of the texts."""

    def run(batches):
        for pdf in batches:
            rows = [(e["type"], e["key"], e["fields"], re.split(r"\s+and\s+", e["fields"]["author"]) if e["fields"].get("author") else []) for t in pdf[column].dropna() for e in parse_bibtex(t)]
            yield pd.DataFrame(rows, columns=["type", "key", "fields", "authors"])

    return files.select(column).mapInPandas(run, "type string, key string, fields map<string,string>, authors array<string>")


def entry_names(entries: DataFrame) -> DataFrame:
    return with_names(entries.select("key", F.explode("authors").alias("author")), "author")
