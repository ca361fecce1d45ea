"""Rules of decisions, reminders and celebrations as column expressions; adapters and callers supply the columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def print_state(stored: Column) -> Column:
    """Whatever is not ordered is done."""
    return F.when(stored == "ordered", "ordered").otherwise("done")


def landing(spot: Column, tagging: Column) -> Column:
    """A struct of tab and mode for a spot; tagging falls back to sorting where it is off."""
    mode = F.when(spot == "prints", None).when((spot == "tag") & ~tagging, "sort").otherwise(spot)
    return F.struct(F.when(spot == "prints", "prints").otherwise("review").alias("tab"), mode.alias("mode"))


def day_complete(done: Column, goal: Column, backlog: Column) -> Column:
    return (done >= goal) | ((done > 0) & (backlog == 0))


def goal_met(done: dict[str, Column], goals: dict[str, Column]) -> Column:
    """The first task whose goal is set and reached."""
    out = F.lit(None).cast("string")
    for task in reversed(done):
        out = F.when((goals[task] > 0) & (done[task] >= goals[task]), task).otherwise(out)
    return out


def stat_matches(kind: Column, least: Column, reaches: Column, pile: Column, streak: Column, edits: Column, arrived: Column) -> Column:
    """A rule on one figure: a pile or edit queue of `least`, a streak among `reaches`, or prints that arrived."""
    return F.when(kind == "pile", pile >= least).when(kind == "streak", F.array_contains(reaches, streak)).when(kind == "edits", edits >= least).otherwise(arrived > 0)


def within_budget(count: Column, last_ms: Column, most: Column, cooldown_days: Column, now_ms: Column) -> Column:
    """Not shown `most` times yet (null: no limit) and not within the cooldown; what was never shown may be."""
    spent = F.coalesce(count >= most, F.lit(False))
    rested = now_ms - last_ms >= F.coalesce(cooldown_days, F.lit(0)) * 86_400_000
    return F.when(count.isNull(), True).otherwise(~spent & rested)


def same_settings(a: Column, b: Column, fields: list[str], count: str) -> Column:
    """All fields alike, and of the count whether there is any."""
    same = (a[count] > 0).eqNullSafe(b[count] > 0)
    for f in fields:
        same = same & a[f].eqNullSafe(b[f])
    return same


def claim_key(guarantee: Column, year: Column, counter: Column, milestone: Column) -> Column:
    """What a guaranteed celebration may be claimed once for: ever, a year, or a counter's milestone."""
    reached = F.concat_ws(":", F.when(milestone.isNotNull(), counter), milestone.cast("string"))
    return F.when(guarantee == "once", "once").when(guarantee == "perYear", year.cast("string")).when(guarantee.isNotNull() & counter.isNotNull() & milestone.isNotNull(), reached)


def fully_scanned(scanned: Column, population: Column) -> Column:
    """A missing count of scanned assets is none of them; without a manifest nothing is known."""
    return population.isNotNull() & (F.coalesce(scanned, F.lit(0)) >= population)


def stereo_verdict(two_d: Column, verdicts: Column) -> Column:
    """One verdict for a set: any edit, or a flat picture, makes it an edit, else any kept frame keeps it."""
    return F.when(two_d | F.array_contains(verdicts, "edit"), "toEdit").when(F.array_contains(verdicts, "keep"), "kept").otherwise("rejected")


def detector(role: Column) -> Column:
    """How groups of an album are found: not at all in albums of one eye, by the union of stereo clusterers where both eyes are, else mixed."""
    return F.when(role.isin("left", "right"), "none").when(role == "both", "stereo").otherwise("mixed")


def date_rule(day: Column, start: Column, end: Column) -> Column:
    """A day against 'MM-DD' or 'YYYY-MM-DD' limits, inclusive; without an end, the one day. A range that ends before it starts goes over
    New Year if neither limit has a year, else it holds nothing. A limit without a year is one of the day's own year."""
    text = F.date_format(day, "yyyy-MM-dd")
    full = lambda x: F.when(F.length(x) > 5, x).otherwise(F.concat(F.date_format(day, "yyyy-"), x))
    a, b = full(start), full(end)
    dated = (F.length(start) > 5) | (F.length(end) > 5)
    return F.when(end.isNull(), a == text).when(a <= b, text.between(a, b)).when(dated, False).otherwise((text >= a) | (text <= b))


def byte_size(value: Column, kind: Column) -> Column:
    """Size by kind: texts by length, numbers eight, anything else by its JSON; nothing has none."""
    return F.when(kind == "number", 8).otherwise(F.coalesce(F.length(value), F.lit(0))).cast("long")


_CAMERA = ("serial", "make", "model")


def _camera_of(document: str | None) -> tuple[str | None, ...]:
    """(serial, make, model) of one JSON text: of its camera block if the first of these that is there says something, else of the first texts,
    depth first in the order of the document, whose key holds 'serial' or is 'make' or 'model'. Empty texts are passed over, and so is what
    is no text. None for what is no JSON."""
    try:
        root = json.loads(document or "null")
    except (ValueError, RecursionError):
        return None, None, None
    own = root.get("camera") if isinstance(root, dict) else None
    if isinstance(own, dict) and next((own[k] for k in _CAMERA if own.get(k) is not None), "") not in ("", 0):
        return tuple(own[k] if isinstance(own.get(k), str) else None for k in _CAMERA)
    out: dict[str, str] = {}
    left = [iter([("", root)])]
    while left:
        key, value = next(left[-1], (None, None))
        if key is None:
            left.pop()
        elif isinstance(value, str):
            name = "serial" if "serial" in key and "serial" not in out else key
            if value and name in _CAMERA and name not in out:
                out[name] = value
        elif isinstance(value, dict):
            numbered = sorted((k for k in value if k.isascii() and k.isdigit() and str(int(k)) == k), key=int)  # such keys come first
            left.append(iter([(k.lower(), value[k]) for k in [*numbered, *(k for k in value if k not in set(numbered))]]))
        elif isinstance(value, list):
            left.append(iter([("", v) for v in value]))
    return tuple(out.get(k) for k in _CAMERA)


def camera_identity(document: Column) -> Column:
    """(serial, make, model) of JSON texts, as _camera_of."""

    @F.pandas_udf("serial string, make string, model string")
    def run(documents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_camera_of(d) for d in documents], columns=_CAMERA)

    return run(document)


def sorted_bins(names: Column, prefix: str) -> Column:
    return F.array_sort(F.filter(names, lambda n: F.startswith(n, F.lit(prefix))))


def search_links(base: str, names: Column, size: int) -> Column:
    """URLs of `size` search terms each."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.concat(F.lit(base), F.array_join(F.transform(F.slice(names, i, F.lit(size)), lambda x: F.url_encode(x)), "%7C"))), lambda _: F.size(names) > 0)


def toggle_frame(selected: Column, frame: Column, order: Column, least: int) -> Column:
    """The selection with the frame taken out or in, in the given order; one of `least` frames loses none."""
    inside = F.array_contains(selected, frame)
    chosen = F.when(inside, F.array_remove(selected, frame)).otherwise(F.array_append(selected, frame))
    return F.when(inside & (F.size(selected) <= least), selected).otherwise(F.filter(order, lambda x: F.array_contains(chosen, x)))
