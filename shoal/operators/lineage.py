"""Joins over file names, groups, verdicts, filings and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import scalar as S


def first_by(rows: DataFrame, key: str, order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key; an aggregate, so rows of a key are thinned out before they meet."""
    return rows.groupBy(key).agg((F.max_by if last else F.min_by)(F.struct(*rows.columns), order).alias("_first")).select("_first.*")


def by_stem(meta: DataFrame) -> DataFrame:
    """(stem, original_id): the last row of each stem wins; edits are no originals."""
    stems = meta.select(F.lower(S.file_stem(F.col("name"))).alias("stem"), F.col("asset_id").alias("original_id"), "ord").where(S.edit_base(F.col("stem")) == F.col("stem"))
    return first_by(stems, "stem", F.col("ord"), last=True).drop("ord")


def edit_pairs(meta: DataFrame) -> DataFrame:
    """Edits and the originals that their names, less one edit suffix, are equal to."""
    stem = F.lower(S.file_stem(F.col("name")))
    edits = meta.where(S.edit_base(stem) != stem).select(F.col("asset_id").alias("edit_id"), S.edit_base(stem).alias("stem"))
    return edits.join(by_stem(meta), "stem").select("edit_id", "original_id")


def album_edit_pairs(meta: DataFrame) -> DataFrame:
    """(album_id, edit_id, original_id) for meta(album_id, asset_id, name, ord), names compared within an album."""
    stems = meta.where("album_id is not null").select("album_id", "asset_id", "ord", F.lower(S.file_stem(F.col("name"))).alias("stem")).withColumn("base", S.edit_base(F.col("stem")))
    last = F.max(F.when(F.col("base") == F.col("stem"), F.struct("ord", "asset_id"))).over(Window.partitionBy("album_id", "base"))
    found = stems.select("album_id", F.col("asset_id").alias("edit_id"), (F.col("base") != F.col("stem")).alias("edited"), last["asset_id"].alias("original_id"))
    return found.where("edited and original_id is not null").select("album_id", "edit_id", "original_id")


def nearest_sources(meta: DataFrame) -> DataFrame:
    """Merged photos and the nearest existing name met while their suffixes are peeled off."""
    stem = S.file_stem(F.col("name"))
    peeled = meta.where(S.merge_kind(stem).isNotNull()).select(F.col("asset_id").alias("merged_id"), S.merge_kind(stem).alias("kind"), F.posexplode(S.merge_sources(F.lower(stem))).alias("level", "stem"))
    names = first_by(meta.select(F.lower(S.file_stem(F.col("name"))).alias("stem"), F.col("asset_id").alias("source_id"), "ord"), "stem", F.col("ord"), last=True).drop("ord")
    return first_by(peeled.join(names, "stem"), "merged_id", F.col("level")).select("merged_id", "kind", "source_id", F.col("level").cast("long").alias("level"))


def overlay(meta: DataFrame, verdicts: DataFrame) -> DataFrame:
    joined = meta.join(verdicts, "asset_id", "left")
    return joined.select("asset_id", "album", F.coalesce("status", F.lit("backlog")).alias("status"), F.coalesce("starred", F.lit(False)).alias("starred"), F.coalesce("save_only", F.lit(False)).alias("save_only"))


def decided(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("status <> 'backlog'").select("asset_id")


def undecided_groups(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Groups of which no member is decided."""
    hit = members.join(decided(verdicts), "asset_id", "left_semi").select("group_id").distinct()
    return members.join(hit, "group_id", "left_anti").groupBy("group_id").agg(F.count("*").alias("n"))


def outstanding(verdicts: DataFrame, filings: DataFrame) -> DataFrame:
    """Verdicts whose album does not hold the asset yet."""
    wanted = verdicts.select("asset_id", S.album_for(F.col("status")).alias("album")).where("album is not null")
    return wanted.join(filings, ["asset_id", "album"], "left_anti")


def stale(verdicts: DataFrame, filings: DataFrame) -> DataFrame:
    """Filings in an album to which the verdict of now does not lead."""
    now = verdicts.select("asset_id", S.album_for(F.col("status")).alias("wanted"))
    return filings.join(now, "asset_id", "left").where("wanted is null or wanted <> album").select("asset_id", "album")


def contents(listing: DataFrame) -> DataFrame:
    """(album, asset_id, gone): tombstones stand for the assets they were."""
    return listing.select("album", F.coalesce("original_id", "id").alias("asset_id"), F.col("original_id").isNotNull().alias("gone"))


def gaps(filings: DataFrame, listing: DataFrame) -> DataFrame:
    """Filed assets that the album neither holds nor had deleted."""
    return filings.select("asset_id", "album").join(contents(listing), ["asset_id", "album"], "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = old.toDF("id", "was"), new.toDF("id", "now")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return o.join(n, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


SMALL_SET = 64


def majority_matches(recorded: DataFrame, detected: DataFrame) -> DataFrame:
    """(recorded, detected, shared) of sets that share more than half of their union. Both hold (set_id, asset_id), distinct. Such sets
    share more than half of each, hence one of the rarer half of the assets of either: only these make candidates, so an asset that
    very many sets hold does not pair all of them. Sets of up to SMALL_SET assets take them along and are compared where they meet; pairs
    with a larger one are counted asset by asset."""
    r, d = recorded.toDF("recorded", "asset_id"), detected.toDF("detected", "asset_id")
    often = r.select("asset_id").union(d.select("asset_id")).groupBy("asset_id").agg(F.count("*").alias("often"))

    def ranked(x: DataFrame, key: str, side: str) -> DataFrame:
        w = Window.partitionBy(key)
        numbered = x.join(often, "asset_id").withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("often", "asset_id")))
        own = F.collect_list(F.when(F.col("n") <= SMALL_SET, F.col("asset_id"))).over(w)
        return numbered.select(key, "asset_id", F.col("n").alias(f"n_{side}"), F.col("k").alias(f"k_{side}"), own.alias(f"own_{side}"))

    r, d = ranked(r, "recorded", "r"), ranked(d, "detected", "d")
    rare = lambda x, side: x.where(F.col(f"k_{side}") <= F.ceil(F.col(f"n_{side}") / 2))
    enough = "3 * (1 + least(n_r - k_r, n_d - k_d)) > n_r + n_d"  # an asset and all that follow it in both
    small = rare(r, "r").where(F.col("n_r") <= SMALL_SET).join(rare(d, "d").where(F.col("n_d") <= SMALL_SET), "asset_id").where(enough)
    near = small.withColumn("shared", F.size(F.array_intersect("own_r", "own_d")).cast("long")).where("2 * shared > n_r + n_d - shared").select("recorded", "detected", "shared").distinct()
    r, d = (x.where(F.col(f"n_{side}") > SMALL_SET // 2).drop(f"own_{side}") for x, side in ((r, "r"), (d, "d")))  # a set is less than twice as large as its match
    large = rare(r, "r").join(rare(d, "d"), "asset_id").where(F.greatest("n_r", "n_d") > SMALL_SET).where(enough).select("recorded", "detected").distinct()
    shared = large.join(r, "recorded").join(d, ["detected", "asset_id"]).groupBy("recorded", "detected").agg(F.count("*").alias("shared"), F.first("n_r").alias("n_r"), F.first("n_d").alias("n_d"))
    return near.union(shared.where("2 * shared > n_r + n_d - shared").select("recorded", "detected", "shared"))


def repaired(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts of edits copied to originals that have none; the smallest edit's counts."""
    have = pairs.join(verdicts, F.col("edit_id") == F.col("asset_id")).select("original_id", "edit_id", "status")
    return first_by(have.join(verdicts.select(F.col("asset_id").alias("original_id")), "original_id", "left_anti"), "original_id", F.col("edit_id")).select("original_id", "status")


def near_pairs(hashes: DataFrame, block: str, most: int) -> DataFrame:
    """Pairs of one block whose 64-bit hashes differ in at most `most` bits. With most <= 7 the pairs come from bands of 8 bits, of
    which two such hashes share one, as an equi-join; beyond that bands select nothing and the block is the key."""
    from shoal.operators.sequences import hamming

    if most <= 7:
        bands = F.array(*[F.call_function("shiftright", F.col(h), F.lit(8 * i)).bitwiseAND(F.lit(255)) + F.lit(256 * (4 * (h == "hi") + i)) for h in ("lo", "hi") for i in range(4)])
        keyed = hashes.withColumn("band", F.explode(bands))
        key = [block, "band"]
    else:
        keyed, key = hashes, [block]
    a, b = (keyed.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("vec_id", "lo", "hi")]) for s in "ab")
    pairs = a.join(b, key).where("vec_id_a < vec_id_b").withColumn("bits", hamming(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))).where(F.col("bits") <= most)
    return pairs.select("vec_id_a", "vec_id_b", F.col("bits").cast("long").alias("bits")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges between longs to (node, component), the smallest node reachable, for every node of an edge.

    In every round each node points at its smallest neighbour if that is smaller, and follows these pointers to their end by doubling,
    so a chain of any length takes a logarithm of it. Edges are rewritten to the ends and those inside one label drop out, so the
    table shrinks quickly. All steps are joins and map-side combined minima, hence no node has to meet its neighbours in one task.
    Each step is checkpointed, the edges first, as whatever makes them would run twice otherwise.
    """
    from shoal.sources.session import materialise

    given = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    labels = materialise(given.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    edges = given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        step, moving = materialise(least), True
        while moving:
            ahead = step.alias("x").join(step.alias("y"), F.col("x.m") == F.col("y.v"))
            both = materialise(ahead.select(F.col("x.v").alias("v"), F.col("y.m").alias("m"), (F.col("x.m") != F.col("y.m")).alias("moved")))
            step, moving = both.select("v", "m"), not both.where("moved").isEmpty()
        labels = materialise(labels.join(step, labels["component"] == step["v"], "left").select("node", F.coalesce("m", "component").alias("component")))
        left = edges.join(step, edges["a"] == step["v"]).select(F.col("m").alias("a"), "b")
        moved = left.join(step, left["b"] == step["v"]).select("a", F.col("m").alias("b"))
        edges = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return labels


def scan_candidates(assets: DataFrame, marked: DataFrame, gap_ms: int, least: int) -> DataFrame:
    """(album_id, asset_id) worth hashing: those of runs in time and camera of `least` assets at least, and all of marked albums."""
    from shoal.operators.sequences import time_runs

    runs = time_runs(assets.join(marked, "album_id", "left_anti"), gap_ms, same_camera=True)
    sized = runs.withColumn("n", F.count("*").over(Window.partitionBy("album_id", "run"))).where(F.col("n") >= least)
    return sized.select("album_id", "asset_id").union(assets.join(marked, "album_id", "left_semi").select("album_id", "asset_id"))


def albums_of_role(roles: DataFrame, role: str) -> DataFrame:
    return roles.where(F.col("role") == role).select("album")


def claimants(links: DataFrame) -> DataFrame:
    """(right_album, left_album): the left album that a right one is linked to."""
    return links.groupBy("right_album").agg(F.min("left_album").alias("left_album"))


def edit_states(baselines: DataFrame, now: DataFrame) -> DataFrame:
    """now(id, updated, hash) against baselines: 'unknown' without one, 'untouched' with the same stamp, else 'edited' where the hash differs
    and 'touched' where it does not."""
    was = baselines.select("id", F.col("updated").alias("was"), F.col("hash").alias("old"))
    state = F.when(F.col("was").isNull(), "unknown").when(F.col("was") == F.col("updated"), "untouched").when(F.col("old") != F.col("hash"), "edited").otherwise("touched")
    return now.join(was, "id", "left").select("id", state.alias("state"))


def large_sets(sets: DataFrame, least: int) -> DataFrame:
    """sets(asset_id, set_id) of `least` assets at least."""
    enough = sets.groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sets.join(enough.select("set_id"), "set_id", "left_semi").select("asset_id", "set_id")


def merges_touching(merges: DataFrame, meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """merges(album_id, frame_ids, ...) of the albums of wanted(asset_id) that hold one of these."""
    albums = meta.join(wanted, "asset_id", "left_semi").select("album_id").distinct()
    near = merges.join(albums, "album_id", "left_semi")
    hit = near.select("merged_id", F.explode("frame_ids").alias("asset_id")).join(wanted, "asset_id", "left_semi").select("merged_id").distinct()
    return near.join(hit, "merged_id", "left_semi")


def dispatched(groups: DataFrame, roles: DataFrame) -> DataFrame:
    """groups with the detector that their album's role asks for; albums of one eye have none and lose theirs."""
    from shoal.functions.rules import detector

    return groups.join(roles, "album_id", "left").withColumn("detector", F.coalesce(detector(F.col("role")), F.lit("mixed"))).where("detector <> 'none'")


def twin_rigs(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """(album_id, left_serial, right_serial): the chosen camera is left if it is there, else the smallest; the smallest other one is right."""
    seen = frames.where("serial <> ''").groupBy("album_id").agg(F.array_sort(F.collect_set("serial")).alias("p")).join(chosen, "album_id", "left")
    left = F.when(F.array_contains("p", F.col("left_serial")), F.col("left_serial")).otherwise(F.col("p")[0])
    both = seen.withColumn("left_serial", left)
    return both.select("album_id", "left_serial", F.coalesce(F.get(F.array_remove("p", F.col("left_serial")), 0), F.col("left_serial")).alias("right_serial"))


def outstanding_assets(verdicts: DataFrame, filings: DataFrame, held: DataFrame) -> DataFrame:
    """As outstanding, without review cards and without assets that an undo still holds back."""
    return outstanding(verdicts.where(~S.is_unit(F.col("asset_id"))), filings).join(held.select("asset_id"), "asset_id", "left_anti")


def album_gaps(filings: DataFrame, listing: DataFrame, purged: DataFrame) -> DataFrame:
    """(album, missing, deleted) of every album with filings: assets filed there that it neither holds nor had deleted nor is known to have
    purged, and the number of its tombstones."""
    lost = gaps(filings, listing).join(purged, ["asset_id", "album"], "left_anti").groupBy("album").agg(F.sort_array(F.collect_set("asset_id")).alias("missing"))
    dead = listing.where("original_id is not null").groupBy("album").agg(F.count("*").alias("deleted"))
    all_ = filings.select("album").distinct().join(lost, "album", "left").join(dead, "album", "left")
    return all_.select("album", F.coalesce("missing", F.array().cast("array<long>")).alias("missing"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


def live_edits(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """(original_id) of originals with an edit that is in no group; pairs(original_id, edit_id), grouped(asset_id)."""
    return pairs.join(grouped.select(F.col("asset_id").alias("edit_id")), "edit_id", "left_anti").select("original_id").distinct()


def edit_candidates(filed: DataFrame, verdicts: DataFrame, gone: DataFrame, merged: DataFrame, sets: DataFrame) -> DataFrame:
    """(place, set_id, lead, n, filed_at): assets filed for editing, still to be edited, neither deleted nor merged photos nor review cards,
    folded to their sets, led by the longest filed; place counts the sets from 0 in the order of their filing."""
    from shoal.operators.running import running_sums

    queued = filed.where(~S.is_unit(F.col("asset_id").cast("string"))).join(verdicts.where("status = 'toEdit'").select("asset_id"), "asset_id", "left_semi")
    queued = queued.join(gone.select("asset_id").union(merged.select("asset_id")).distinct(), "asset_id", "left_anti")
    folded = queued.join(sets, "asset_id").groupBy("set_id").agg(F.min_by("asset_id", F.struct("filed_at", "asset_id")).alias("lead"), F.count("*").alias("n"), F.min("filed_at").alias("filed_at"))
    return running_sums(folded, ["filed_at", "set_id"], {"place": F.lit(1)})


def remembered(assets: DataFrame, known: DataFrame) -> DataFrame:
    """Assets not known yet that are merged photos or a name met while peeling one."""
    stem = F.lower(S.file_stem(F.col("name")))
    new = assets.join(known.select("asset_id"), "asset_id", "left_anti").select("asset_id", stem.alias("stem"))
    peeled = assets.where(S.merge_kind(stem).isNotNull()).select(F.explode(S.merge_sources(stem)).alias("stem")).distinct()
    return new.where(S.merge_kind(F.col("stem")).isNotNull()).select("asset_id").union(new.join(peeled, "stem", "left_semi").select("asset_id")).distinct()


def find_merges(meta: DataFrame, sets: DataFrame, queued: DataFrame) -> DataFrame:
    """(merged_id, kind, frame_id): merged photos whose nearest existing source, or any frame of the set that holds it, is queued, with all
    these frames. sets(set_id, asset_id): of several sets of an asset the last counts; a source in none stands for itself."""
    near = nearest_sources(meta).select("merged_id", "kind", "source_id")
    of = sets.groupBy("asset_id").agg(F.max("set_id").alias("set_id"))
    held = near.join(of.withColumnRenamed("asset_id", "source_id"), "source_id", "left")
    frames = held.join(sets.select("set_id", F.col("asset_id").alias("frame_id")), "set_id", "left").select("merged_id", "kind", F.coalesce("frame_id", "source_id").alias("frame_id"))
    hit = frames.join(queued.select(F.col("asset_id").alias("frame_id")), "frame_id", "left_semi").select("merged_id").distinct()
    return frames.join(hit, "merged_id", "left_semi").select("merged_id", "kind", "frame_id").distinct()
