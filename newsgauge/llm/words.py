"""Native column helpers for words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# blank, tab, line feed, vertical tab, form feed, carriage return
SPACE = r"[\x20\x09-\x0D]"


def body(text: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The runs of other than white space, in order."""
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened by underscores until the frame has no such column."""
    taken, free = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def without(frame: DataFrame, *names: str) -> list[Column]:
    """The frame's columns but those with one of the names."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in frame.columns if c.lower() not in gone]
