"""Text columns: built-in functions where they say it, Arrow functions where only Python has the rule."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

SPACE = r"(?U)\s+"


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def comparison(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean(c)), r"(?U)[^\w\s]", "")


def words(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def join_nonempty(c: Column, sep: str = " ") -> Column:
    return F.array_join(F.filter(F.transform(c, lambda t: F.trim(t)), lambda t: F.length(t) > 0), sep)


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; fractions are cut and negative times are 0."""
    s = F.greatest(F.lit(0), seconds.cast("bigint"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    hours = F.when(h < 100, two(h)).otherwise(h.cast("string"))
    return F.when(h > 0, F.concat_ws(":", hours, two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def plain(c: Column) -> Column:
    """Composed to NFC (which Spark has no function for), without control characters, white space collapsed."""
    return clean(F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), r"[\p{C}&&[^\n\t]]", ""))


def truncate(c: Column, max_characters: int, max_words: int) -> Column:
    """At most so many words and characters, cut at a word, with an ellipsis if cut."""
    w = words(plain(c))
    few = F.array_join(F.slice(w, 1, max_words), " ")
    cut = F.rtrim(F.substring(few, 1, max_characters))
    back = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    over = F.length(few) > max_characters
    out = F.when(over, back).otherwise(few)
    dots = F.concat(F.regexp_replace(out, r"[ .,…]+$", ""), F.lit("…"))
    return F.when(((F.size(w) > max_words) | over) & (F.length(out) > 0), dots).otherwise(out)


def filename(c: Column, max_length: int = 120) -> Column:
    """A safe name for a download."""
    t = plain(F.when(F.coalesce(c, F.lit("")) == "", F.lit("Lecture Notes")).otherwise(c))
    t = F.regexp_replace(F.translate(t, "/\\", "  "), r"(?U)[^\w\- .()]+", "")
    ends = lambda x: F.regexp_replace(x, r"^[-._ ]+|[-._ ]+$", "")
    t = ends(F.regexp_replace(t, r"(?U)\s+", "-"))
    t = F.when(t == "", F.lit("lecture-notes")).otherwise(t)
    t = F.regexp_replace(t, r"(?i)\.pdf$", "")
    t = F.regexp_replace(F.substring(t, 1, max_length), r"[-._ ]+$", "")
    return F.concat(F.when(t == "", F.lit("lecture-notes")).otherwise(t), F.lit(".pdf"))


#: Names of content types for people (fixed values).
CONTENT_NAMES = {
    "SLIDE": "Slide", "WHITEBOARD": "Whiteboard", "BLACKBOARD": "Blackboard", "CODE": "Code", "DIAGRAM": "Diagram", "EQUATION": "Equation",
    "DOCUMENT": "Document", "UI_DEMO": "UI Demo", "MIXED": "Mixed", "OTHER": "Other", "EMPTY_OR_LOW_INFORMATION": "Low information", "UNKNOWN": "Unknown",
}


def content_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CONTENT_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, F.upper(c)), F.lit("Unknown"))


def similarity(a: str | None, b: str | None) -> float:
    """0 if either is empty, 1 if one holds the other, else the matching-blocks ratio."""
    x, y = (re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", (t or "").strip()).lower()) for t in (a, b))
    if not x or not y:
        return 0.0
    return 1.0 if x in y or y in x else SequenceMatcher(None, x, y, autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def canonical(value, drop_none: bool = False) -> str:
    """JSON with sorted keys and no spaces; with ``drop_none`` null members are left out."""
    if drop_none and isinstance(value, dict):
        value = {k: v for k, v in value.items() if v is not None}
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def fingerprint(value, drop_none: bool = False) -> str:
    return hashlib.sha256(canonical(value, drop_none).encode()).hexdigest()


@F.pandas_udf(StringType())
def json_fingerprint(s: pd.Series) -> pd.Series:
    """SHA-256 of JSON text in canonical form."""
    return s.map(lambda t: None if t is None else fingerprint(json.loads(t)))


def ids_fingerprint(ids: Column) -> Column:
    """The canonical fingerprint of a list of integers, without Python."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("]")), 256)


def wrapped(c: Column, width: float, font: float, lines: int) -> Column:
    """A struct (text, cut): lines of about the width, long words split, at most ``lines``; whether something was left out.

    One fold over the words: the state is the lines so far, and a word that does not fit its line's room begins another.
    """
    room = max(1, int(width / max(font * 0.58, 1.0)))
    text = F.coalesce(c, F.lit(""))
    parts = F.transform(words(text), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / room).cast("int")), lambda k: F.substring(w, k * room + 1, F.lit(room))))

    def add(held: Column, w: Column) -> Column:
        last = F.element_at(held, -1)
        fits = (F.size(held) > 0) & (F.length(last) + 1 + F.length(w) <= room)
        return F.when(fits, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(held, F.array(w)))

    every = F.aggregate(F.flatten(parts), F.array().cast("array<string>"), add)

    def cut(held: Column) -> Column:
        end = F.concat(F.regexp_replace(F.substring(F.element_at(held, lines), 1, max(1, room - 1)), r"[ .,…]+$", ""), F.lit("…"))
        few = F.concat(F.slice(held, 1, lines - 1), F.array(end)) if lines > 1 else F.array(end)
        over = F.size(held) > lines
        return F.struct(F.array_join(F.when(over, few).otherwise(held), "\n").alias("text"), over.alias("cut"))

    return F.element_at(F.transform(F.array(every), cut), 1)  # the fold stands once


#: Parts of names whose values are not shown, and what stands for them (fixed values).
SENSITIVE = ("password", "secret", "token", "authorization", "cookie", "api_key", "private_key")
REDACTED = "***REDACTED***"


def is_sensitive(name: Column) -> Column:
    lower = F.lower(name)
    return reduce(lambda a, b: a | b, [lower.contains(part) for part in SENSITIVE])


def redact(props: Column) -> Column:
    """Values of sensitive keys of a flat map are replaced."""
    return F.transform_values(props, lambda k, v: F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(v))


def redacted(value, name: str = ""):
    """The value without what sensitive names hold, at any depth; items of a list go by the list's name."""
    if any(part in name.lower() for part in SENSITIVE):
        return REDACTED
    if isinstance(value, dict):
        return {k: redacted(v, k) for k, v in value.items()}
    return [redacted(v, name) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def redact_json(s: pd.Series) -> pd.Series:
    """JSON text with the values of sensitive names replaced at any depth; text that is not JSON becomes null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(redacted(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)
