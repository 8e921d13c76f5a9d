"""Text preparation before encoding, and name rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# What each encoder profile does to missing or blank text before encoding.
#   keep            text is used as it is
#   blank_to_space  '' becomes ' '
#   null_to_blank   missing becomes ''
#   null_to_space   missing becomes ' '
TEXT_RULES = {
    "bert": "blank_to_space",
    "all-mpnet-base-v2": "null_to_blank",
    "simcse": "keep",
    "angle-bert": "null_to_blank",
    "angle-llama": "null_to_blank",
    "llama-7B": "null_to_space",
    "llama2-7B": "null_to_space",
    "text-embedding-3-small": "null_to_blank",
}
# Fixed value: tokens kept by the encoders that truncate.
MAX_TOKENS = 64
# Fixed value: texts given to an encoder per call.
ENCODE_BATCH = 32
# Whitening method names as the results show them.
METHOD_LABELS = {"zca_cor": "zca-cor", "pca_cor": "pca-cor"}


@dataclass(frozen=True)
class Profile:
    """How one encoder wants its texts."""

    name: str
    rule: str = "keep"
    template: str | None = None
    max_tokens: int | None = None
    batch_size: int = ENCODE_BATCH

    @classmethod
    def of(cls, name: str, **options) -> "Profile":
        if name not in TEXT_RULES:
            raise ValueError(f"unknown encoder profile {name!r}")
        return cls(name, TEXT_RULES[name], **options)


def clean_text(text: Column, rule: str) -> Column:
    if rule == "keep":
        return text
    if rule == "blank_to_space":
        return F.when(text == "", F.lit(" ")).otherwise(text)
    if rule == "null_to_blank":
        return F.coalesce(text, F.lit(""))
    if rule == "null_to_space":
        return F.coalesce(text, F.lit(" "))
    raise ValueError(f"unknown text rule {rule!r}")


def decorate(text: Column, template: str) -> Column:
    """Put the text into a prompt template with one ``{text}`` slot."""
    if template.count("{text}") != 1:
        raise ValueError("the template needs exactly one {text} slot")
    before, after = template.split("{text}")
    return F.concat(F.lit(before), text, F.lit(after))


def words(text: Column) -> Column:
    """Tokens at runs of blanks, tabs and line ends; blank text has none."""
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\r\n]+"))


def prepare_text(text: Column, profile: Profile) -> Column:
    """Null and blank rule, then the prompt template, then the profile's token limit if it has one."""
    prepared = clean_text(text, profile.rule)
    if profile.template is not None:
        prepared = decorate(prepared, profile.template)
    if profile.max_tokens is not None:
        kept = F.slice(words(prepared), 1, profile.max_tokens)
        prepared = F.when(F.size(words(prepared)) > profile.max_tokens, F.concat_ws(" ", kept)).otherwise(prepared)
    return prepared


def token_table(df: DataFrame, key: str = "row_id", text_col: str = "text") -> DataFrame:
    """One row per token: ``(key, token_pos, token)`` with positions from 0."""
    return df.select(key, F.posexplode(words(F.col(text_col))).alias("token_pos", "token"))


def truncate_tokens(tokens: DataFrame, max_tokens: int = MAX_TOKENS, position: str = "token_pos") -> DataFrame:
    return tokens.where(F.col(position) < max_tokens)


def strip_side(name: str) -> str:
    """``stsb1`` -> ``stsb``: drop the side digit of a pair dataset's name."""
    if not re.fullmatch(r"[a-z]+\d*[12]", name):
        raise ValueError(f"{name!r} carries no side digit")
    return name[:-1]


def method_label(method: str) -> str:
    return METHOD_LABELS.get(method, method)


def whitened_name(method: str, encoder: str) -> str:
    """Name of a whitened variant of an encoder in score files."""
    return f"wh{method_label(method)}-{encoder}"
