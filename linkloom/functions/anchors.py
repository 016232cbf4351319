"""Anchor text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import is_plain, null_if_empty, or_empty, strip_space, title_case

# Anchor kinds, phrases that say nothing about their target, default texts.
ANCHOR_TYPES = ["exact", "partial", "contextual", "generic"]
GENERIC_PHRASES = [
    "cliquez ici",
    "click here",
    "en savoir plus",
    "lire la suite",
    "voir plus",
    "learn more",
    "read more",
    "découvrir",
    "decouvrir",
    "ici",
]
GENERIC_TEXT = "En savoir plus"
NO_LABEL = "destination"

SELECTOR_BUCKETS = 10_000


def label_from_path(path: Column) -> Column:
    """Readable name of a path: its last piece (the one before it for ``_meta``), title-cased."""
    whole = F.regexp_replace(F.regexp_replace(or_empty(path), r"/\z", ""), r"^_meta\z", NO_LABEL)
    piece = F.regexp_replace(F.regexp_replace(whole, r"/_meta\z", ""), r"(?s)^.*/", "")
    return title_case(F.translate(piece, "-_", "  "))


def coalesce_anchor_text(anchor: Column, alt: Column, target_path: Column) -> Column:
    """Anchor text, else the image's alternative text, else the target's label."""
    text, alternative = strip_space(anchor), strip_space(alt)
    return F.coalesce(null_if_empty(text), null_if_empty(alternative), label_from_path(target_path))


def anchor_lexical_normal(anchor: Column) -> Column:
    return lexical_of(F.lower(or_empty(anchor)))


def lexical_of(text: Column) -> Column:
    """Lexical normal form of a text in lower case."""
    words = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.when(is_plain(text), text).otherwise(words)


def classify_anchor(anchor: Column, label: Column) -> Column:
    """Anchor kind from an anchor and a label that are both in lexical normal form."""
    overlaps = anchor.startswith(label) | anchor.endswith(label) | label.startswith(anchor)
    long_enough = (F.length(anchor) >= 3) & (F.length(label) >= 3)
    return (
        F.when(anchor.isin(GENERIC_PHRASES) | (anchor == ""), F.lit("generic"))
        .when(anchor == label, F.lit("exact"))
        .when(overlaps & long_enough, F.lit("partial"))
        .otherwise(F.lit("contextual"))
    )


def infer_anchor_type(anchor: Column, target_path: Column) -> Column:
    return classify_anchor(anchor_lexical_normal(anchor), anchor_lexical_normal(label_from_path(target_path)))


def anchor_token_count(anchor: Column) -> Column:
    """Pieces between single spaces; empty pieces count, so ``''`` has one."""
    return F.size(F.split(anchor, " ", -1)).cast("int")


def scenario_selector(source_id: Column, target_id: Column, block_type: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1) for one edge, the same in any engine with md5."""
    key = F.concat_ws(":", source_id.cast("string"), target_id.cast("string"), block_type)
    head = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return (head % SELECTOR_BUCKETS) / F.lit(SELECTOR_BUCKETS)


def anchor_type_choice(selector: Column, exact: Column, partial: Column, contextual: Column) -> Column:
    """Anchor kind under cumulative shares; ``partial`` and ``contextual`` are upper bounds."""
    return (
        F.when(selector < exact, F.lit("exact"))
        .when(selector < partial, F.lit("partial"))
        .when(selector < contextual, F.lit("contextual"))
        .otherwise(F.lit("generic"))
    )
