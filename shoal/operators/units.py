"""Review units: groups, edited pairs and single assets of albums, and the sets and decks made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import scalar as S
from shoal.operators import lineage
from shoal.operators.selection import draw


def build(assets: DataFrame, groups: DataFrame, gaps: DataFrame) -> DataFrame:
    """Units (unit_id, kind, album_id, n, taken, original_id, members) of albums.

    assets(album_id, asset_id, name, ms, ord), groups(group_id, album_id, type, asset_id, pos), gaps(asset_id, missing). A group whose
    album holds two of its members at least, edits not counted, is a unit. Of the assets in no group's unit, a gap is an incomplete
    pair, an edit whose original is free stands for both, and any other asset is a single unless a free edit stands for it. Edits and group
    units are kept, as each is read three times or more."""
    from shoal.sources.session import materialise

    edits = materialise(lineage.album_edit_pairs(assets).select("album_id", F.col("edit_id").alias("asset_id"), "original_id"))
    held = groups.join(assets.select("album_id", "asset_id", "ms"), ["album_id", "asset_id"]).join(edits, ["album_id", "asset_id"], "left_anti")
    member = F.struct("pos", "asset_id")
    grouped = held.groupBy("group_id", "type", "album_id").agg(F.sort_array(F.collect_set(member)).alias("m"), F.min("ms").alias("taken")).where(F.size("m") >= 2)
    units = materialise(grouped.select(S.unit_id(F.col("type"), F.col("album_id"), F.col("m")[0]["asset_id"]).alias("unit_id"), F.col("type").alias("kind"), "album_id", F.size("m").alias("n"), "taken", F.lit(None).cast("long").alias("original_id"), F.transform("m", lambda x: x["asset_id"]).alias("members")))
    used = units.select("album_id", F.explode("members").alias("asset_id")).distinct()
    free = assets.select("album_id", "asset_id", "ms").join(used, ["album_id", "asset_id"], "left_anti")
    open_edits = edits.join(used.withColumnRenamed("asset_id", "original_id"), ["album_id", "original_id"], "left_anti")
    stands_for = edits.join(used, ["album_id", "asset_id"], "left_anti").select("album_id", F.col("original_id").alias("asset_id"), F.lit(True).alias("replaced")).distinct()
    rest = free.join(gaps.select("asset_id", "missing"), "asset_id", "left").join(open_edits, ["album_id", "asset_id"], "left").join(stands_for, ["album_id", "asset_id"], "left")
    kind = F.when(F.col("missing").isNotNull(), "incomplete").when(F.col("original_id").isNotNull(), "edit").otherwise("photo")
    singles = rest.withColumn("kind", kind).where("kind <> 'photo' or replaced is null")
    own = F.when(F.col("kind") == "incomplete", F.concat(F.lit("stereo-gap:"), F.col("asset_id").cast("string"))).otherwise(F.col("asset_id").cast("string"))
    original = F.when(F.col("kind") == "edit", F.col("original_id"))
    return units.unionByName(singles.select(own.alias("unit_id"), "kind", "album_id", F.lit(1).alias("n"), F.col("ms").alias("taken"), original.alias("original_id"), F.array("asset_id").alias("members")))


def asset_ids(kind: Column, members: Column, original: Column) -> Column:
    """All assets that a unit holds; an edit also holds its original."""
    return F.when(kind == "edit", F.concat(members, F.array(original))).otherwise(members)


def unit_members(units: DataFrame) -> DataFrame:
    """(unit_id, album_id, asset_id) of every unit."""
    return units.select("unit_id", "album_id", F.explode(asset_ids(F.col("kind"), F.col("members"), F.col("original_id"))).alias("asset_id"))


def holders(units: DataFrame, ids: DataFrame) -> DataFrame:
    """(unit_id, asset_id) of the units that are an id themselves or hold it; single cards are only held by their own id."""
    named = ids.select(F.col("asset_id").cast("string").alias("unit_id"), "asset_id")
    cards = unit_members(units.where("kind in ('burst', 'pano', 'stereo', 'incomplete')")).join(ids.select("asset_id"), "asset_id").select("unit_id", "asset_id")
    return units.select("unit_id").join(named, "unit_id").union(cards).distinct()


def disjoint(members: DataFrame, rank: str) -> DataFrame:
    """Units that a greedy pass in order of `rank` takes when no asset may be in two of them: members(unit_id, asset_id, rank).
    Units that share no asset are taken at once. Of the others in every round those that come first for all their assets are taken, and
    those that share an asset with them go."""
    from shoal.sources.session import materialise

    members = materialise(members.select("unit_id", "asset_id", rank))
    shared = members.groupBy("asset_id").agg(F.min("unit_id").alias("one"), F.max("unit_id").alias("two")).where("one < two").select("asset_id")
    contested = materialise(members.join(shared, "asset_id", "left_semi").select("unit_id").distinct())
    taken = members.join(contested, "unit_id", "left_anti").select("unit_id").distinct()
    left = materialise(members.join(contested, "unit_id", "left_semi"))
    while not left.isEmpty():
        first = left.groupBy("asset_id").agg(F.min(F.struct(rank, "unit_id")).alias("first"))
        won = left.join(first, "asset_id").groupBy("unit_id").agg(F.bool_and(F.col("first.unit_id") == F.col("unit_id")).alias("won")).where("won").select("unit_id")
        won = materialise(won)
        taken = taken.union(won)
        gone = left.join(won, "unit_id", "left_semi").select("asset_id").distinct()
        hit = left.join(gone, "asset_id", "left_semi").select("unit_id").distinct()
        left = materialise(left.join(hit, "unit_id", "left_anti"))
    return taken


def select_units(units: DataFrame, weight: Column, limit: int, most: int, seed: str) -> DataFrame:
    """Units of a deck: albums in weighted drawn order give at most `most` units each, in drawn order; what they hold back fills the
    deck up to `limit` in one more drawn order. No asset comes twice; units that share one are of one album. Returns the units with their
    place in a last shuffle."""
    from shoal.sources.session import materialise

    units = materialise(units)
    drawn = units.withColumn("pick", draw(f"{seed}:unit", F.col("unit_id")))
    albums = units.select("album_id").distinct().withColumn("copy", F.explode(F.sequence(F.lit(1), weight))).groupBy("album_id").agg(F.min(draw(f"{seed}:album", F.col("album_id"), F.col("copy"))).alias("album_draw"))
    ranked = drawn.join(albums, "album_id").withColumn("rank", F.concat("album_draw", "pick"))
    members = unit_members(ranked).join(ranked.select("unit_id", "rank"), "unit_id")
    own = ranked.join(disjoint(members, "rank"), "unit_id")
    w = Window.partitionBy("album_id").orderBy("rank")
    first = own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    first = materialise(first.orderBy("rank").limit(limit))
    last = first.groupBy("album_id").agg(F.max(F.struct("k", "rank")).alias("last")).where(F.col("last.k") == most).select("album_id", F.col("last.rank").alias("full_at"))
    later = ranked.join(last, "album_id").where("rank > full_at").withColumn("again", draw(f"{seed}:rest", F.col("unit_id")))
    used = unit_members(first).select("asset_id").distinct()
    hit = unit_members(later).join(used, "asset_id", "left_semi").select("unit_id").distinct()
    later = later.join(hit, "unit_id", "left_anti")
    more = later.join(disjoint(unit_members(later).join(later.select("unit_id", "again"), "unit_id"), "again"), "unit_id")
    both = first.select(*units.columns, F.lit(0).alias("pass"), F.col("rank").alias("key")).unionByName(more.select(*units.columns, F.lit(1).alias("pass"), F.col("again").alias("key")))
    picked = both.orderBy("pass", "key").limit(limit)
    return picked.withColumn("place", draw(f"{seed}:deck", F.col("unit_id"))).drop("pass", "key")


def fresh(units: DataFrame, verdicts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Units of which no asset is excluded or decided."""
    taken = excluded.select("asset_id").union(lineage.decided(verdicts)).distinct()
    hit = unit_members(units).join(taken, "asset_id", "left_semi").select("unit_id").distinct()
    return units.join(hit, "unit_id", "left_anti")


def buffer_fill(drawn: DataFrame, verdicts: DataFrame, excluded: DataFrame, count: int) -> DataFrame:
    """The first `count` fresh units in the order of their draw; decided ones take no place."""
    return fresh(drawn, verdicts, excluded).orderBy("place", "unit_id").limit(count)


def server_feed(assets: DataFrame, weight: Column, limit: int, per_album: int, seed: str) -> DataFrame:
    """Up to `limit` assets: at most `per_album` of each album in drawn order, or the first assets of the flat list if no album gives any."""
    w = Window.partitionBy("album_id").orderBy(draw(seed, F.col("asset_id")), "asset_id")
    by_album = assets.where("album_id is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_album * weight)
    fed = by_album.select("asset_id", draw(f"{seed}:all", F.col("asset_id")).alias("place")).orderBy("place").limit(limit)
    flat = assets.orderBy("asset_id").limit(limit).select("asset_id", F.lpad(F.col("asset_id").cast("string"), 32, "0").alias("place"))
    none = fed.agg(F.count("*").alias("n")).where("n = 0")  # one row or none
    return fed.union(flat.join(F.broadcast(none)).select("asset_id", "place"))


def bring_back(deck: DataFrame, units: DataFrame, index: Column, to_place: Column) -> DataFrame:
    """deck(deck_id, pos, unit_id, assets) with units(deck_id, unit_id, assets) brought back, one for each deck: units that share its
    assets leave; it returns to its old place where asked and still there, else in front of the cursor. Returns (deck_id, pos, unit_id)."""
    back = units.select("deck_id", F.col("unit_id").alias("back"), F.col("assets").alias("own"), index.alias("index"), to_place.alias("place"))
    both = deck.join(back, "deck_id").where((F.col("unit_id") == F.col("back")) | ~F.arrays_overlap("assets", "own"))
    w = Window.partitionBy("deck_id")
    numbered = both.withColumn("i", F.row_number().over(w.orderBy("pos")) - 1)
    placed = numbered.withColumn("at", F.max(F.when(F.col("unit_id") == F.col("back"), F.col("i"))).over(w)).withColumn("n", F.count("*").over(w))
    stays = F.col("place") & F.col("at").isNotNull()
    others = placed.where(stays | (F.col("unit_id") != F.col("back")))
    heads = back.select("deck_id", "back", "index", "place").join(placed.select("deck_id", "at", "n").distinct(), "deck_id", "left")
    size = F.coalesce("n", F.lit(0)) - F.when(F.col("at").isNotNull(), 1).otherwise(0)
    cursor = F.least(F.when(F.col("at") < F.col("index"), F.col("index") - 1).otherwise(F.col("index")), size)
    heads = heads.where(~(F.col("place") & F.col("at").isNotNull())).select("deck_id", (cursor.cast("double") - 0.5).alias("key"), F.col("back").alias("unit_id"))
    shifted = F.when(~stays & (F.col("i") > F.col("at")), F.col("i") - 1).otherwise(F.col("i")).cast("double")
    rows = others.select("deck_id", shifted.alias("key"), "unit_id").union(heads)
    return rows.select("deck_id", (F.row_number().over(w.orderBy("key")) - 1).cast("long").alias("pos"), "unit_id")


def assemble(deck: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """A unit of chosen(deck_id, unit_id, frames) takes the place of unit_id; units of the deck that share a frame are absorbed. Fewer
    than two frames change nothing."""
    valid = chosen.where(F.size("frames") >= 2).select("deck_id", F.col("unit_id").alias("current"), "frames")
    both = deck.join(valid, "deck_id", "left")
    stays = F.col("current").isNull() | (F.col("unit_id") == F.col("current")) | ~F.arrays_overlap("assets", "frames")
    new = F.when(F.col("unit_id") == F.col("current"), S.retyped_any(F.col("unit_id"), kind)).otherwise(F.col("unit_id"))
    held = F.when(F.col("unit_id") == F.col("current"), F.col("frames")).otherwise(F.col("assets"))
    w = Window.partitionBy("deck_id").orderBy("pos")
    return both.where(stays).select("deck_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), new.alias("unit_id"), held.alias("assets"))


def gather_by_set(items: DataFrame, groups: DataFrame) -> DataFrame:
    """items(asset_id, ord) to (asset_id, unit_ord, place): items of one set are gathered where its first one stands; of several sets of
    an asset the last holds it."""
    last = groups.groupBy("asset_id").agg(F.max("group_id").alias("group_id"))
    own = items.join(last, "asset_id", "left").withColumn("key", F.coalesce("group_id", F.concat(F.lit("#"), F.col("ord").cast("string"))))
    w = Window.partitionBy("key")
    return own.select("asset_id", F.min("ord").over(w).alias("unit_ord"), F.row_number().over(w.orderBy("ord")).cast("long").alias("place"))


def shot_sets(names: DataFrame, groups: DataFrame, merges: DataFrame) -> DataFrame:
    """(asset_id, set_id) for names(asset_id, stem, ord): assets joined by groups(key, asset_id), by merges(key, asset_id), or by a name
    that is another's less one edit suffix or any number of merge suffixes. set_id is the smallest asset of the set."""
    linked = groups.select(F.concat(F.lit("g"), F.col("key").cast("string")).alias("key"), "asset_id").union(merges.select(F.concat(F.lit("m"), F.col("key").cast("string")).alias("key"), "asset_id"))
    heads = linked.groupBy("key").agg(F.min("asset_id").alias("b"))
    stem = F.lower("stem")
    owner = names.groupBy(stem.alias("source")).agg(F.max(F.struct("ord", "asset_id"))["asset_id"].alias("b"))
    sources = F.explode(F.concat(F.when(S.edit_base(stem) != stem, F.array(S.edit_base(stem))).otherwise(F.array().cast("array<string>")), S.merge_sources(stem)))
    derived = names.select(F.col("asset_id").alias("a"), sources.alias("source")).join(owner, "source").select("a", "b")
    edges = linked.join(heads, "key").select(F.col("asset_id").alias("a"), "b").union(derived)
    parts = lineage.components(edges)
    return names.select("asset_id").join(parts.withColumnRenamed("node", "asset_id"), "asset_id", "left").select("asset_id", F.coalesce("component", "asset_id").alias("set_id"))


def candidate_window(wanted: DataFrame, assets: DataFrame, verdicts: DataFrame, groups: DataFrame, reach: int) -> DataFrame:
    """(album_id, asset_id, mine) offered as further frames of the units in wanted(album_id, asset_id): undecided assets of the album within
    `reach` ranks of the unit's, stretched over groups that overlap the window, and over those that overlap it then, to the end. Only
    groups that are undecided throughout and hold none of the unit's stretch it."""
    decided = lineage.decided(verdicts).withColumn("decided", F.lit(True))
    mine = wanted.select("album_id", "asset_id").distinct().withColumn("mine", F.lit(True))
    marked = assets.select("album_id", "asset_id", "ms").join(decided, "asset_id", "left").join(mine, ["album_id", "asset_id"], "left").where("mine or decided is null")
    w = Window.partitionBy("album_id")
    ranked = marked.withColumn("rank", F.row_number().over(w.orderBy(F.col("ms").asc_nulls_first(), "asset_id")))
    windows = ranked.where("mine").groupBy("album_id").agg((F.min("rank") - reach).alias("first"), (F.max("rank") + reach).alias("last")).withColumn("own", F.lit(True))
    spans = groups.join(ranked.select("album_id", "asset_id", "rank", "mine"), ["album_id", "asset_id"], "left").groupBy("album_id", "group_id").agg(F.count("*").alias("n"), F.count("rank").alias("offered"), F.count_if("mine").alias("held"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    every = windows.unionByName(spans.where("n = offered and held = 0").select("album_id", "first", "last", F.lit(False).alias("own")))
    order = w.orderBy("first", "last", "own")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("island", F.sum(F.when(F.col("first") <= before, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wide = islands.groupBy("album_id", "island").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.bool_or("own").alias("own")).where("own")
    return ranked.join(wide.select("album_id", "lo", "hi"), "album_id").where(F.col("rank").between(F.col("lo"), F.col("hi"))).select("album_id", "asset_id", F.coalesce("mine", F.lit(False)).alias("mine"))


def settle(halves: DataFrame, status: str) -> DataFrame:
    """Verdict rows for halves(unit_id, members) of incomplete pairs: the unit and its frames get one status and no flags."""
    ids = F.explode(F.concat(F.array("unit_id"), "members"))
    return halves.select(ids.alias("asset_id"), F.lit(status).alias("status"), F.lit(False).alias("starred"), F.lit(False).alias("save_only"))


def frames_to_photos(bursts: DataFrame, assets: DataFrame) -> DataFrame:
    """A burst's frames as single photos: the burst's album and time, no verdict."""
    frames = bursts.select("album_id", "taken", F.explode("members").alias("asset_id"))
    blank = [F.lit("backlog").alias("status"), F.lit(False).alias("starred"), F.lit(False).alias("save_only")]
    return frames.join(assets.select("album_id", "asset_id", "name"), ["album_id", "asset_id"]).select("asset_id", S.file_stem(F.col("name")).alias("name"), F.col("album_id").alias("album"), "taken", *blank)


def undo(verdicts: DataFrame, prior: DataFrame) -> DataFrame:
    """The verdicts of prior come back; those whose status was null are deleted."""
    return verdicts.join(prior.select("asset_id"), "asset_id", "left_anti").unionByName(prior.where("status is not null"))


def tag_queue(sets: DataFrame, verdicts: DataFrame, tagged: DataFrame) -> DataFrame:
    """(set_id, asset_id): the newest keeper of every shot set of which no asset is tagged."""
    done = sets.join(tagged.select("asset_id"), "asset_id", "left_semi").select("set_id").distinct()
    kept = verdicts.where(F.col("status").isin("kept", "toPrint")).select("asset_id")
    return sets.join(kept, "asset_id").join(done, "set_id", "left_anti").groupBy("set_id").agg(F.max("asset_id").alias("asset_id"))


def stereo_sets(sets: DataFrame, assets: DataFrame) -> DataFrame:
    """sets(asset_id, set_id) as stereo units: name, number of frames and earliest time."""
    made = sets.join(assets.select("asset_id", "ms"), "asset_id").groupBy("set_id").agg(F.count("*").alias("n"), F.min("ms").alias("taken"))
    return made.select("set_id", S.unit_name(F.lit("stereo"), F.col("n")).alias("name"), "n", "taken")


def take_front(queue: DataFrame, verdicts: DataFrame, excluded: DataFrame, count: int) -> DataFrame:
    """Units of queue(deck_id, pos, unit columns) that are not stale, and whether each is among the first `count` of its deck."""
    usable = fresh(queue, verdicts, excluded)
    return usable.withColumn("taken", F.row_number().over(Window.partitionBy("deck_id").orderBy("pos")) <= count)


def withdraw(deck: DataFrame, current: DataFrame, doomed: Column) -> DataFrame:
    """(deck_id, n, cursor_at) of deck(deck_id, pos, unit_id, open) without the doomed units: the cursor stays on the current(deck_id,
    current) unit, else it goes to the first open one, else to the start."""
    w = Window.partitionBy("deck_id").orderBy("pos")
    left = deck.where(~doomed).withColumn("i", (F.row_number().over(w) - 1).cast("long")).join(current, "deck_id")
    at = F.coalesce(F.max(F.when(F.col("unit_id") == F.col("current"), F.col("i"))), F.min(F.when(F.col("open"), F.col("i"))), F.lit(0).cast("long"))
    return left.groupBy("deck_id").agg(F.count("*").alias("n"), at.alias("cursor_at"))


def resolve_bursts(bursts: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, dissolved, units) of bursts(unit_id, members) of which the frames of kept(asset_id) are kept. verdicts(asset_id, status): frames
    that are not kept are rejected, and so is the burst itself if none is. dissolved(unit_id, members): its group is never offered again.
    units(unit_id, kind, status, members) take its place: what is left of it, rejected, and a photo of its own for each kept frame."""
    frames = bursts.select("unit_id", F.explode("members").alias("asset_id")).join(kept.select("asset_id", F.lit(True).alias("kept")).distinct(), "asset_id", "left")
    survivors, culled = frames.where("kept"), frames.where("kept is null")
    left = culled.groupBy("unit_id").agg(F.sort_array(F.collect_set("asset_id")).alias("members"))
    whole = culled.select("unit_id").distinct().join(survivors, "unit_id", "left_anti")
    verdicts = culled.select(F.col("asset_id").cast("string").alias("asset_id")).union(whole).distinct().select("asset_id", F.lit("rejected").alias("status"))
    singles = survivors.select(F.col("asset_id").cast("string").alias("unit_id"), F.lit("photo").alias("kind"), F.lit(None).cast("string").alias("status"), F.array("asset_id").alias("members"))
    remains = left.select("unit_id", F.lit("burst").alias("kind"), F.lit("rejected").alias("status"), "members")
    return verdicts, bursts.select("unit_id", F.sort_array("members").alias("members")), remains.unionByName(singles)


def assembly_records(deck: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """(deck_id, record, unit_id, detected, frames, type) that assemble() leaves for later selections, deck(deck_id, unit_id, assets, ...): the frames
    that the user put in place of those detected ('members'), what kind of group they are ('type'), and of each unit that they absorb
    that it is dissolved."""
    valid = chosen.where(F.size("frames") >= 2).select("deck_id", F.col("unit_id").alias("current"), "frames")
    both = deck.join(valid, "deck_id")
    own = both.where(F.col("unit_id") == F.col("current"))
    none = F.array().cast("array<long>")
    record = lambda f, name, frames, of: f.select("deck_id", F.lit(name).alias("record"), "unit_id", F.sort_array("assets").alias("detected"), frames.alias("frames"), F.lit(of).alias("type"))
    absorbed = both.where((F.col("unit_id") != F.col("current")) & F.arrays_overlap("assets", "frames"))
    return record(own, "members", F.array_sort("frames"), None).unionByName(record(own, "type", none, kind)).unionByName(record(absorbed, "dissolved", none, None))
