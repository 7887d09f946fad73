"""Match positions with Spark's own functions.

Spark gives the matches of a pattern, or what lies between them, but no positions. Both lists
together give every position: a match begins after all earlier matches and gaps. Patterns here are
written so that Java neither retries a run of characters from each of its positions (a look-behind
admits run starts, or where the last match ended) nor recurses (possessive groups).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
#: Characters before and after a match that are searched for context words.
NEAR = 40


def spans(text: Column, kind: str, rank: int, pattern: str, valid: Callable[[Column], Column], score: Callable[[Column, Column], Column], cue: str | None = None) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches that are valid. `score` gets the match and the text around it, up to the next matches; `cue` is a substring that every match has (a cheap test)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The gaps are bound to a lambda's name, so that the text is split once.
    found = F.get(F.transform(F.array(F.split(text, pattern, -1)), lambda gaps: F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))), F.lit(0))
    none = F.lit(None).cast(SPAN)
    empty = F.coalesce(none, F.array().cast(SPAN))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score(x["hit"], F.concat(F.right(x["gap"], F.lit(NEAR)), F.lit("\n"), F.left(x["next"], F.lit(NEAR)))).cast("double").alias("score"))
        kept = F.when(F.coalesce(valid(x["hit"]), F.lit(False)), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), kept.cast(SPAN).alias("out"))

    got = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    here = text.rlike(pattern) if cue is None else F.contains(text, F.lit(cue)) & text.rlike(pattern)
    return F.when(here, got).otherwise(empty)


def joined(found: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def only(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def count(found: Column, kind: str) -> Column:
    return F.size(only(found, kind)).cast("long")


def masked(text: Column, found: Column) -> Column:
    """text with each span replaced by [KIND]; of overlapping spans, the one that begins first (then the first listed) is replaced, and what the others reach beyond it goes too."""
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.char_length(text)))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, init, step, finish))
