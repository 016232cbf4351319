"""Functions over the raw attributes of one hyperlink, and over page scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import is_plain, or_empty, strip_space

# Accepted spellings of "true" and the base weight of each link position.
TRUE_WORDS = ["true", "1", "yes", "y"]
POSITION_WEIGHTS = {"content": 1.0, "navigation": 0.9, "footer": 0.45, "head": 0.25}
OTHER_POSITION_WEIGHT = 0.6

# What a template alias of a link block stands for.
TEMPLATE_ALIASES = {
    "/c/": ["c_L0", "c_L1", "c_L2", "c_L3"],
    "/ck/": ["ck"],
    "/ckl/": ["ckl"],
    "/cl/": ["cl"],
    "/l/": ["l"],
    "/ad/": ["ad"],
    "homepage": ["homepage"],
    "all": ["c_L0", "c_L1", "c_L2", "c_L3", "ck", "ckl", "cl", "l", "ad", "homepage", "dc", "guide"],
}


def parse_boolean(text: Column) -> Column:
    return F.lower(strip_space(or_empty(text))).isin(TRUE_WORDS)


def normalize_block_type(position: Column) -> Column:
    return block_type_of(F.lower(strip_space(or_empty(position))))


def block_type_of(position: Column) -> Column:
    """Block type of a position that is stripped and in lower case."""
    slug = F.trim(F.regexp_replace(position, r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(position == "", F.lit("unknown")).when(is_plain(position), F.translate(position, " ", "_")).when(slug == "", F.lit("unknown")).otherwise(slug)


def block_rule_weight(block_type: Column) -> Column:
    weight = F.lit(OTHER_POSITION_WEIGHT)
    for block, value in POSITION_WEIGHTS.items():
        weight = F.when(block_type == block, F.lit(value)).otherwise(weight)
    return weight.cast("float")


def juice_score(cheirank: Column, out_degree: Column) -> Column:
    return cheirank * F.log(out_degree.cast("double") + 1.0)


def power_label(can_give_juice: Column, is_low_power: Column) -> Column:
    return (
        F.when(can_give_juice, F.lit("donor")).when(is_low_power, F.lit("low_power")).otherwise(F.lit("normal"))
    )


def expand_templates(aliases: Iterable[str]) -> list[str]:
    """Concrete template names behind a block's ``present_on`` entries; unknown names stay."""
    names: set[str] = set()
    for alias in aliases:
        names.update(TEMPLATE_ALIASES.get(alias, [alias]))
    return sorted(names)


def alias_templates(alias: Column) -> Column:
    """The same expansion for a column of aliases, as an array of template names."""
    known = F.create_map(
        *[item for name, templates in TEMPLATE_ALIASES.items()
          for item in (F.lit(name), F.array(*[F.lit(t) for t in templates]))]
    )
    return F.coalesce(F.try_element_at(known, alias), F.array(alias))
