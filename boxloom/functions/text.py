"""Name, path and annotation-text rules as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def family_of(name: Column) -> Column:
    """Original photo of an export: the file name up to ``.rf.``, else the stem."""
    base = base_name(name)
    return F.when(base.contains(".rf."), F.substring_index(base, ".rf.", 1)).otherwise(stem(name))


# fixed values: capture-grouping rules by source
VIDEO_SOURCE = "rf_embedded_hardware"
VIDEO_PATTERN = r"^((?:AURIX|Raspberry_Pi|STM32)_\d+_MOV)-(\d+)_(?:jpg|jpeg|png)$"
SCENE_SOURCE = "rf_raspberry_pi_dpiwf"
SCENE_NAME = "six_pi_cluster"
DAY_SOURCE = "rf_raspberrypi_vniye"
DAY_PATTERN = r"^(\d{8})_(\d{6})(?:[-_].*)?$"


def capture_group(source: Column, name: Column) -> Column:
    """Group key of a capture: video, fixed scene, capture day, else the augmentation family."""
    family = family_of(name)
    video = F.regexp_extract(family, VIDEO_PATTERN, 1)
    stamp = F.concat(F.regexp_extract(family, DAY_PATTERN, 1), F.regexp_extract(family, DAY_PATTERN, 2))
    day = F.to_date(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMddHHmmss")))
    return (
        F.when((source == VIDEO_SOURCE) & (video != ""), F.concat_ws(":", source, F.lit("video"), video))
        .when(source == SCENE_SOURCE, F.concat_ws(":", source, F.lit("scene"), F.lit(SCENE_NAME)))
        .when(
            (source == DAY_SOURCE) & day.isNotNull(),
            F.concat_ws(":", source, F.lit("capture_day"), day.cast("string")),
        )
        .otherwise(F.concat_ws(":", source, family))
    )


def frame_index(name: Column) -> Column:
    return F.regexp_extract(family_of(name), VIDEO_PATTERN, 2).try_cast("int")


def source_type(name: Column) -> Column:
    """Leading quoted phrase or first token of an annotation name."""
    text = F.trim(name)
    quoted = F.regexp_extract(text, r'^"([^"]+)"', 1)
    return F.lower(F.when(quoted != "", quoted).otherwise(F.regexp_extract(text, r"^(\S+)", 1)))


def source_refdes(name: Column) -> Column:
    """What follows the type; NULL when nothing does."""
    rest = F.regexp_extract(name, r'^\s*(?:"[^"]+"|\S+)\s*(.*)$', 1)
    return F.nullif(F.trim(rest), F.lit(""))


def board_group(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)_(top|bottom)\d*$", "")


def is_original(name: Column, pattern: str) -> Column:
    return name.rlike(pattern)


# fixed values: named character references that occur in metadata text
NAMED_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_text(markup: Column) -> Column:
    """Tags removed, the common named references decoded (ampersand last)."""
    out = F.regexp_replace(markup, r"<[^>]+>", "")
    for entity, char in NAMED_ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """Every HTML character reference, for the cases ``plain_text`` does not list."""
    return text.map(html.unescape, na_action="ignore")


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"[^0-9A-Za-z_-]", "_")


SPLIT_FOLDERS = ["train", "val", "valid", "validation", "test"]


def provider_split(path: Column) -> Column:
    """First split-named folder of the path, ``unknown`` without one."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hits = F.filter(folders, lambda p: F.lower(p).isin(SPLIT_FOLDERS))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit("unknown"))


def route_target(target: Column, status: Column, default_model: Column) -> dict[str, Column]:
    """Mapping entry to (model, class, status): dropped, pending, or ``model:class``."""
    drop = target == "drop"
    pending = target.startswith("needs_") | status.startswith("needs_")
    named = target.contains(":")
    model = F.when(named, F.substring_index(target, ":", 1)).otherwise(default_model)
    cls = F.when(named, F.regexp_replace(target, r"^[^:]*:", "")).otherwise(target)
    return {
        "model": F.when(drop, "dropped").when(pending, "pending").otherwise(model),
        "class_name": F.when(drop, F.lit(None)).when(pending, target).otherwise(cls),
        "status": F.when(drop, "drop").otherwise(status),
    }
