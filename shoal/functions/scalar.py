"""Scalar functions over columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0
VERDICTS_IN_ORDER = ("backlog", "kept", "toPrint", "toEdit", "maybe", "rejected")
FILED_IN = {"toEdit": "Edit", "kept": "Keep", "toPrint": "Print"}


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def file_stem(name: Column) -> Column:
    at = F.length(name) - F.instr(F.reverse(name), ".") + 1
    return F.when((F.instr(name, ".") > 0) & (at > 1) & (at < F.length(name)), F.substring(name, F.lit(1), at - 1)).otherwise(name)


def file_ext(name: Column) -> Column:
    at = F.length(name) - F.instr(F.reverse(name), ".") + 1
    return F.when((F.instr(name, ".") > 0) & (at > 1) & (at < F.length(name)), F.substring(name, at + 1, F.length(name)))


def is_unit(asset_id: Column) -> Column:
    return F.contains(asset_id, F.lit(":"))


def edit_base(stem: Column) -> Column:
    """The stem without one edit suffix."""
    return F.regexp_replace(stem, "(?i)-(Enhanced-NR|Enhanced|Edit)$", "")


def merge_kind(stem: Column) -> Column:
    tail = F.regexp_extract(stem, r"(?i)((?:-(?:HDR|Pano)(?:-\d+)?)+)$", 1)
    hdr, pano = tail.rlike("(?i)-HDR"), tail.rlike("(?i)-Pano")
    return F.when(hdr & pano, "HDR panorama").when(hdr, "HDR").when(pano, "panorama")


def merge_sources(stem: Column) -> Column:
    """Every stem met while merge suffixes are peeled off, nearest first."""
    tail = F.regexp_extract(stem, r"(?i)((?:-(?:HDR|Pano)(?:-\d+)?)+)$", 1)
    parts = F.regexp_extract_all(tail, F.lit(r"(?i)(-(?:HDR|Pano)(?:-\d+)?)"), F.lit(1))
    base = F.substring(stem, F.lit(1), F.length(stem) - F.length(tail))
    kept = F.transform(parts, lambda _, i: F.concat(base, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i - 1), "")))
    return F.when(F.size(parts) > 0, kept).otherwise(F.array().cast("array<string>"))


def eye(stem: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(stem, "(?i)[_-]([LR])$", 1)), F.lit(""))


def retyped(unit_id: Column, kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.regexp_replace(unit_id, "^(?:burst:|pano:)+", ""))


def retyped_any(unit_id: Column, kind: str) -> Column:
    """The unit id under another kind; a plain asset id becomes a unit of that kind."""
    return F.concat(F.lit(f"{kind}:"), F.regexp_replace(unit_id, "^(?:(?:burst|pano|stereo):)+", ""))


def unit_id(kind: Column, album: Column, first: Column) -> Column:
    return F.concat_ws(":", kind, album.cast("string"), first.cast("string"))


def set_signature(members: Column) -> Column:
    """One text for a set of ids, whatever their order."""
    return F.array_join(F.array_sort(F.transform(members, lambda x: x.cast("string"))), "|")


def frames(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " frame").otherwise(" frames"))


def set_label(kind: Column, n: Column) -> Column:
    name = F.when(kind == "pano", "Panorama").when(kind == "burst", "Burst").when(kind == "stereo", "Stereo")
    return F.concat(name, F.lit(" · "), frames(n))


def unit_name(kind: Column, n: Column) -> Column:
    name = F.when(kind == "pano", "Panorama").when(kind == "burst", "Burst").otherwise("Stereo set")
    return F.concat(name, F.lit(" · "), n.cast("string"), F.lit(" frames"))


def gap_label(missing: Column) -> Column:
    return F.when(missing == "unknown", "Stereo pair · no other eye").otherwise(F.concat(F.lit("Stereo pair · "), missing, F.lit(" eye missing")))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_METRES * F.asin(F.least(F.lit(1.0), F.sqrt(a))))  # least() would pass over a null


def swipe_verdict(dx: Column, dy: Column, right: str = "kept", left: str = "rejected", up: str = "toEdit", down: str = "maybe") -> Column:
    """The dominant axis decides, ties go to x; no movement decides nothing."""
    flat = F.abs(dx) >= F.abs(dy)
    return F.when((dx == 0) & (dy == 0), None).when(flat & (dx > 0), right).when(flat, left).when(dy < 0, up).otherwise(down)


def swipe_strength(dx: Column, dy: Column, commit: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.abs(dx), F.abs(dy)) / commit)


def swipe_sector(dx: Column, dy: Column) -> Column:
    return F.pmod(half_up(F.atan2(dy, dx) * 4 / F.pi()), F.lit(8))


def time_of_day(text: Column) -> Column:
    """Minutes of 'H:mm', null if it is none."""
    h, m = (F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", i), F.lit("")), F.lit("99")).cast("int") for i in (1, 2))
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def byte_label(n: Column) -> Column:
    """SI units, one decimal below ten."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        v = n / float(1000**power)
        text = F.when(v < 10, F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)).otherwise(half_up(v).cast("string"))
        out = F.when(n >= 1000**power, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def search_term(name: Column) -> Column:
    return F.regexp_replace(file_stem(name), r"^\d{4}-\d{2}-\d{2}-", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def album_for(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for s, album in FILED_IN.items():
        out = F.when(status == s, album).otherwise(out)
    return out


def in_print_bin(status: Column, save_only: Column) -> Column:
    return ~F.coalesce(save_only, F.lit(False)) & status.isin("kept", "toPrint")


def verdict_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS_IN_ORDER)), status)


def percent(done: Column, goal: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(done * 100.0, goal), F.lit(0.0)))


def template(text: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), value.cast("string"))
    return text


def date_matches(day: Column, start: Column, end: Column) -> Column:
    """Month-day ranges (MM-dd), inclusive, over New Year where the start is after the end."""
    md = F.date_format(day, "MM-dd")
    return F.when(start <= end, md.between(start, end)).otherwise((md >= start) | (md <= end))


def json_guard(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*while\s*\(1\)\s*\{\s*\}\s*", "")


def fingerprint(lines: Column) -> Column:
    """FNV-1a of ASCII text, 32 bits."""
    codes = F.transform(F.split(lines, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)
