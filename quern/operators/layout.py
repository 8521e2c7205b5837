"""Storage zones from rules: which items lie together, and how many zones an order's items touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.order import numbered
from quern.sources.stage import stored

#: Items whose zones are grown one by one on the driver; a larger catalogue grows all zones at once, in rounds.
CATALOGUE = 5_000
#: Random layouts that a layout is measured against.
RANDOM = 5


def popularity(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count("*").alias("n"))


def popularity_zones(items: DataFrame, capacity: int) -> DataFrame:
    """(item, zone): items in order of popularity, `capacity` to a zone."""
    return _by_popularity(popularity(items), capacity)


def _by_popularity(counts: DataFrame, capacity: int) -> DataFrame:
    return numbered(counts, [F.desc("n"), "item"], "_place").select("item", F.floor((F.col("_place") - 1) / capacity).cast("long").alias("zone"))


def random_zones(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(item, zone): items in the order of a hash of themselves and the seed, so that reruns agree."""
    names = items.select("item").distinct().withColumn("_h", F.md5(F.concat_ws(":", "item", F.lit(str(seed)))))
    return numbered(names, ["_h", "item"], "_place").select("item", F.floor((F.col("_place") - 1) / capacity).cast("long").alias("zone"))


def _grown(edges: list, counts: dict, capacity: int) -> list[tuple[str, int]]:
    near: dict[str, dict[str, float]] = {}
    for e in edges:
        if e.a in counts and e.b in counts:
            near.setdefault(e.a, {})[e.b] = e.weight
            near.setdefault(e.b, {})[e.a] = e.weight
    ties = lambda i: (-counts[i], i)
    by_pull = sorted(counts, key=lambda i: (-sum(near.get(i, {}).values()), *ties(i)))
    by_fame = sorted(counts, key=ties)
    free, out, zone = set(counts), [], 0
    seeds, fillers = iter(by_pull), iter(by_fame)
    while free:
        chosen, pull = next(i for i in seeds if i in free), {}
        for k in range(1, capacity + 1):
            free.discard(chosen)
            out.append((chosen, zone))
            pull.pop(chosen, None)
            if k == capacity or not free:
                break
            for other, w in near.get(chosen, {}).items():
                if other in free:
                    pull[other] = pull.get(other, 0.0) + w
            drawn = min(pull, key=lambda i: (-pull[i], i)) if pull else None
            chosen = drawn if drawn is not None and pull[drawn] > 0 else next(i for i in fillers if i in free)
        zone += 1
    return out


def merged_zones(edges: DataFrame, items: DataFrame, capacity: int) -> DataFrame:
    """(item, zone): zones of single items merge with the zone they are drawn to most, where both draw each other most and fit together.

    Rounds over all zones at once: the strongest pair of all always merges, so each round brings
    some together until none fits.  Items that no zone draws fill the free places, the most popular
    first, and then zones of their own.
    """
    counts = stored(popularity(items), "popularity")
    zones = stored(counts.select("item", F.col("item").alias("zone")), "zones")
    links = stored(edges.where("weight > 0").select("a", "b", "weight"), "edges")
    while True:
        size = zones.groupBy("zone").agg(F.count("*").alias("size"))
        of = lambda name: zones.select(F.col("item").alias(name), F.col("zone").alias(f"z{name}"))
        sized = lambda name: size.select(F.col("zone").alias(f"z{name}"), F.col("size").alias(f"s{name}"))
        pairs = links.join(of("a"), "a").join(of("b"), "b").where("za <> zb").groupBy(F.least("za", "zb").alias("za"), F.greatest("za", "zb").alias("zb")).agg(F.sum("weight").alias("w"))
        fitting = stored(pairs.join(sized("a"), "za").join(sized("b"), "zb").where(F.col("sa") + F.col("sb") <= capacity).select("za", "zb", F.struct(F.col("w"), F.col("za"), F.col("zb")).alias("pull")), "fitting")
        if fitting.isEmpty():
            break
        best = fitting.select(F.col("za").alias("z"), "pull").union(fitting.select("zb", "pull")).groupBy("z").agg(F.max("pull").alias("pull"))
        mutual = best.groupBy("pull").agg(F.count("*").alias("k")).where("k = 2").select(F.col("pull.zb").alias("_from"), F.col("pull.za").alias("_to"))
        zones = stored(zones.join(mutual, F.col("zone") == F.col("_from"), "left").select("item", F.coalesce("_to", "zone").alias("zone")), "zones")
    fame = zones.join(counts, "item").groupBy("zone").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    grown = numbered(fame.where("size > 1"), [F.desc("n"), "zone"], "no")
    start = grown.agg(F.count("*").alias("grown"))
    slots = grown.where(F.col("size") < capacity).select("no", F.explode(F.sequence(F.lit(1), (F.lit(capacity) - F.col("size")).cast("int"))).alias("k"))
    slots = stored(numbered(slots, ["no", "k"], "place").select("place", (F.col("no") - 1).alias("slot")), "slots")
    rest = numbered(fame.where("size = 1").select(F.col("zone").alias("item"), "n"), [F.desc("n"), "item"], "place")
    taken = slots.agg(F.count("*").alias("slots"))
    filled = rest.join(slots, "place", "left").join(F.broadcast(start)).join(F.broadcast(taken)).select(
        "item", F.coalesce("slot", F.col("grown") + F.floor((F.col("place") - 1 - F.col("slots")) / capacity)).cast("long").alias("zone"))
    return zones.join(grown.select("zone", "no"), "zone").select("item", (F.col("no") - 1).alias("zone")).union(filled)


def affinity_zones(edges: DataFrame, items: DataFrame, capacity: int, most: int = CATALOGUE) -> DataFrame:
    """(item, zone): each zone starts at the free item of most affinity, takes the items that its members draw most, and is filled by popularity.

    Ties go to the more popular item, then to the smaller one.  Each choice depends on those before,
    so up to `most` items are placed on the driver; beyond that zones merge in rounds (merged_zones).
    """
    counts = stored(popularity(items), "popularity")
    if counts.limit(most + 1).count() > most:
        return merged_zones(edges, items, capacity)
    out = _grown(edges.collect(), {r["item"]: r["n"] for r in counts.collect()}, capacity)
    return edges.sparkSession.createDataFrame(out, "item string, zone long")


def efforts(items: DataFrame, layouts: DataFrame) -> DataFrame:
    """(layout, baskets, mean_zones, median_zones, most_zones, single_share) of (layout, item, zone) tables.

    Baskets of equal items are counted first and measured once.  An item meets its zones of all
    layouts as one row, so that no shuffle grows with the number of layouts, which are few.
    """
    names = sorted(r.layout for r in layouts.select("layout").distinct().collect())
    alike = items.groupBy("invoice_id").agg(F.sort_array(F.collect_set("item")).alias("held")).groupBy("held").agg(F.count("*").alias("k"))
    kinds = stored(alike.withColumn("no", F.monotonically_increasing_id()), "kinds")
    places = layouts.groupBy("item").agg(*[F.max(F.when(F.col("layout") == name, F.col("zone"))).alias(f"z{i}") for i, name in enumerate(names)])
    each = kinds.select("no", "k", F.explode("held").alias("item")).join(places, "item").groupBy("no").agg(
        F.max("k").alias("k"), *[F.size(F.collect_set(f"z{i}")).cast("long").alias(f"n{i}") for i in range(len(names))])
    counted = each.select("k", F.explode(F.array(*[F.struct(F.lit(name).alias("layout"), F.col(f"n{i}").alias("zones")) for i, name in enumerate(names)])).alias("x"))
    spread = counted.select("x.*", "k").where("zones > 0").groupBy("layout", "zones").agg(F.sum("k").alias("k"))
    share = lambda value: F.sum(value * F.col("k")) / F.sum("k")
    return spread.groupBy("layout").agg(
        F.sum("k").alias("baskets"), share(F.col("zones")).alias("mean_zones"), F.percentile("zones", 0.5, F.col("k")).alias("median_zones"), F.max("zones").alias("most_zones"),
        share((F.col("zones") == 1).cast("long")).alias("single_share"))


def picking_effort(items: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones that a basket touches: mean, median, most, and the share of baskets in one zone; baskets without a placed item do not count."""
    return efforts(items, zones.withColumn("layout", F.lit("all"))).drop("layout")


def baselines(items: DataFrame, capacity: int, random: int = RANDOM) -> DataFrame:
    """(layout, item, zone) of the order of popularity and of `random` seeded shuffles."""
    counts = stored(popularity(items), "popularity")
    out = _by_popularity(counts, capacity).select(F.lit("popularity").alias("layout"), "item", "zone")
    for seed in range(1, random + 1):
        out = out.union(random_zones(counts, capacity, seed).select(F.lit(f"random_{seed}"), "item", "zone"))
    return out


def evaluated(items: DataFrame, zones: DataFrame, capacity: int, random: int = RANDOM) -> DataFrame:
    """One row: a layout's effort, the random layouts' mean and the popularity layout's, by how much it is less, and a verdict.

    All layouts are measured in one pass over the baskets.  "adds to popularity" needs fewer zones
    than both, "adds to chance" than the random ones only, "adds nothing" than neither.
    """
    every = baselines(items, capacity, random).unionByName(zones.select(F.lit("rules").alias("layout"), "item", F.col("zone").cast("long").alias("zone")))
    each = stored(efforts(items, every), "efforts")
    own = each.where("layout = 'rules'").drop("layout")
    others = each.agg(F.avg(F.when(F.col("layout").startswith("random"), F.col("mean_zones"))).alias("random_mean"), F.max(F.when(F.col("layout") == "popularity", F.col("mean_zones"))).alias("popularity_mean"))
    less = lambda c: F.try_divide(F.col(c) - F.col("mean_zones"), F.col(c))
    rows = own.join(F.broadcast(others)).withColumn("less_than_random", less("random_mean")).withColumn("less_than_popularity", less("popularity_mean"))
    used = zones.agg(F.count_distinct("zone").alias("zones_used"))
    return rows.join(F.broadcast(used)).withColumn("verdict", F.when(F.col("less_than_random") <= 0, "adds nothing").when(F.col("less_than_popularity") <= 0, "adds to chance").otherwise("adds to popularity"))
