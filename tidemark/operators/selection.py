"""Next items of adaptive tests: eight strategies over an index by ability, limits on exposure and content, stop rules.

Learners are never joined with the whole bank. Abilities are dealt to cells of width WIDTH; every item gets the least
and the greatest score that it can have in a cell, and stays a candidate there only if its greatest score reaches the
least one of the k-th item. k is what a learner of that cell may need: the items wanted and those taken already, rounded
up to a power of two; a small k is tried first, and whose best of its candidates isn't surely the best asks again. So candidates are exact for every learner of the cell, and a bank of n items costs n times the
cells that occur, of which there are at most (HIGH - LOW) / WIDTH + 1, for each third or turn where a strategy goes by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .choice import chosen
from .iterate import cut
from .learner import information, p_correct

#: Range of abilities and width of a cell.
LOW, HIGH, WIDTH = -4.0, 4.0, 0.1
#: Longest test, standard error to reach, items to draw from, distance for divergence, chances at the ends
#: of the zone of development, and the range and weight of mastery in the fused score.
LENGTH, ERROR, DRAWN, DELTA, HARD, EASY, MASTERY_LOW, MASTERY_HIGH, FUSION = 20, 0.3, 5, 1.0, 0.4, 0.7, 0.3, 0.7, 0.5
STRATEGIES = ("fisher_info", "b_match", "kl_info", "randomesque", "zpd_aware", "progressive", "a_stratified", "bkt_irt_fusion")
#: Scores are compared at this many digits; equal ones are taken by item.
DIGITS = 9
#: Items with the same of these (and layer, where it counts) have the same score for every learner.
_ALIKE = ("a", "b", "c", "zone")


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 2.0**32


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of two chances."""
    near = lambda x: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), x))
    p, q = near(p), near(q)
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def share(turn: Column) -> Column:
    """How much information counts against chance in the progressive strategy: grows from turn to turn up to 1."""
    informed = F.when(turn > 0, turn.cast("double")).otherwise(1.0) * ERROR * ERROR
    return F.least(F.lit(1.0), F.greatest(informed, turn / float(LENGTH - 1)))


def layer(turn: Column) -> Column:
    """Third of the bank by discrimination, from 0, that a turn takes its items from."""
    done = F.least(turn / float(LENGTH), F.lit(1.0))
    return F.when(done < 0.33, 0).when(done < 0.67, 1).otherwise(2)


def with_layer(items: DataFrame, buckets: int = 4096) -> DataFrame:
    """items with layer: thirds of the bank by (a, item). Only the buckets of discrimination that hold an end are sorted.

    The layers are those of the whole bank, so they don't move with what a learner has taken.
    """
    ends = F.broadcast(items.agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("total")))  # one row
    wide = F.when(F.col("high") > F.col("low"), (F.col("a") - F.col("low")) / (F.col("high") - F.col("low")) * buckets).otherwise(0.0)
    d = items.join(ends).withColumn("bucket", F.least(F.floor(wide), F.lit(buckets - 1)))
    counts = d.groupBy("bucket", "total").agg(F.count("*").alias("inside"))
    before = F.coalesce(F.sum("inside").over(Window.partitionBy("total").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most so many buckets
    low = F.greatest(F.floor(F.col("total") / 3), F.lit(1))
    middle = F.greatest(F.floor(2 * F.col("total") / 3), low + 1)
    counts = counts.withColumn("before", before).withColumn("low_end", low).withColumn("middle_end", middle)
    third = lambda place: F.when(place <= F.col("low_end"), 0).when(place <= F.col("middle_end"), 1).otherwise(2)
    first, last = third(F.col("before") + 1), third(F.col("before") + F.col("inside"))
    d = d.select(*items.columns, "bucket").join(F.broadcast(counts.select("bucket", "before", "inside", "low_end", "middle_end")), "bucket")
    whole = d.where(first == last).select(*items.columns, first.alias("layer"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("a", "item"))
    return whole.unionByName(d.where(first != last).select(*items.columns, third(place).alias("layer")))


def _cell(theta: Column) -> Column:
    return F.floor((F.greatest(F.lit(LOW), F.least(F.lit(HIGH), theta)) - LOW) / WIDTH).cast("int")


def _bounds(strategy: str) -> tuple[Column, Column, Column, Column]:
    """(may take part, takes part surely, least score, greatest score) of an item for the abilities from t0 to t1."""
    a, b, c, t0, t1 = (F.col(x) for x in ("a", "b", "c", "t0", "t1"))
    yes = F.lit(True)
    if strategy == "b_match":
        far = F.greatest(F.abs(b - t0), F.abs(b - t1))
        return yes, yes, -far, F.when((b >= t0) & (b <= t1), 0.0).otherwise(-F.least(F.abs(b - t0), F.abs(b - t1)))
    if strategy == "kl_info":
        p0, p1, q0, q1 = (p_correct(t, a, b, c) for t in (t0, t1, t0 + DELTA, t1 + DELTA))
        # convex in both chances: greatest at a corner, least where they are nearest
        return yes, yes, F.when(p1 < q0, divergence(p1, q0)).otherwise(0.0), F.greatest(*(divergence(p, q) for p in (p0, p1) for q in (q0, q1)))
    # information rises up to one ability and falls after it
    peak = b + F.log((1 + F.sqrt(1 + 8 * c)) / 2) / a
    least = F.least(information(t0, a, b, c), information(t1, a, b, c))
    most = information(F.greatest(t0, F.least(t1, peak)), a, b, c)
    if strategy == "progressive":
        w, r = share(F.col("turn")), draw(F.col("item"), F.col("turn"))
        return yes, yes, (1 - w) * r + w * least, (1 - w) * r + w * most
    if strategy == "zpd_aware":
        p0, p1 = p_correct(t0, a, b, c), p_correct(t1, a, b, c)
        return (p1 > HARD) & (p0 < EASY), (p0 > HARD) & (p1 < EASY), least, most
    if strategy == "solvable":
        far = F.greatest(F.abs(b - t0), F.abs(b - t1))
        return p_correct(t1, a, b, c) > HARD, p_correct(t0, a, b, c) > HARD, -far, F.when((b >= t0) & (b <= t1), 0.0).otherwise(-F.least(F.abs(b - t0), F.abs(b - t1)))
    if strategy == "a_stratified":
        return F.col("layer") == F.col("turn"), F.col("layer") == F.col("turn"), least, most
    return yes, yes, least, most


def _score(strategy: str) -> tuple[Column, Column]:
    """(takes part, score) of an item for the ability theta."""
    a, b, c, theta = (F.col(x) for x in ("a", "b", "c", "theta"))
    p, info, near = p_correct(theta, a, b, c), information(theta, a, b, c), -F.abs(b - theta)
    yes = F.lit(True)
    if strategy in ("b_match", "solvable"):
        return (p > HARD if strategy == "solvable" else yes), near
    if strategy == "kl_info":
        return yes, divergence(p, p_correct(theta + DELTA, a, b, c))
    if strategy == "progressive":
        w = share(F.col("turn"))
        return yes, (1 - w) * draw(F.col("item"), F.col("turn")) + w * info
    if strategy == "zpd_aware":
        return (p > HARD) & (p < EASY), info
    return (F.col("layer") == F.col("turn") if strategy == "a_stratified" else yes), info


def best_items(learners: DataFrame, items: DataFrame, taken: DataFrame, strategy: str, n: int = 1, by_area: bool = False) -> DataFrame:
    """(learner, item, a, b, c, area, score, rank) of the n best items that each learner hasn't taken, ties by item.

    learners: learner, theta; items: item, a, b, c, area (and layer for a_stratified), no item twice; taken: learner,
    item. Learners to whom a strategy offers nothing have no row. With by_area the n best of each area are ranked.
    """
    taken = taken.join(items.select("item"), "item", "left_semi").dropDuplicates(["learner", "item"])
    # what a strategy makes of the turn: its third of the bank, or the turn up to that from which information alone counts
    n_taken = F.least(F.coalesce("n", F.lit(0)), F.lit(LENGTH))
    turn = {"a_stratified": layer(n_taken), "progressive": F.least(n_taken, F.lit(math.ceil(1 / (ERROR * ERROR) - 1e-9)))}.get(strategy, F.lit(0))
    people = learners.select("learner", "theta").where("theta is not null and not isnan(theta)").join(taken.groupBy("learner").agg(F.count("*").alias("n")), "learner", "left")
    people = people.select("learner", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("theta"))).alias("theta"), turn.cast("long").alias("turn"), F.coalesce("n", F.lit(0)).alias("n"))
    # a zone is ranked for itself; only what a learner has taken of it can stand before the items wanted
    items = items.withColumn("zone", F.coalesce(F.concat(F.lit("="), F.col("area").cast("string")), F.lit("")) if by_area else F.lit(""))
    if by_area:
        inside = taken.join(items.select("item", "zone"), "item").groupBy("learner", "zone").agg(F.count("*").alias("n"))
        people = people.drop("n").crossJoin(F.broadcast(items.select("zone").distinct())).join(inside, ["learner", "zone"], "left")
    else:
        people = people.withColumn("zone", F.lit(""))
    people = people.select("learner", "theta", "turn", "zone", F.ceil(F.log2(F.coalesce("n", F.lit(0)) + F.lit(float(n)))).cast("int").alias("level"))
    people = cut(people.withColumn("cell", _cell(F.col("theta"))))
    # few have taken what is best for them: all ask for a few candidates first, and those whose best isn't sure ask for all
    few = math.ceil(math.log2(4 * n))
    asked = people.withColumn("level", F.least("level", F.lit(few)))
    found, bar = _search(asked, items, taken, strategy, n)
    found = cut(found)
    sure = found.where("bar is null or score >= bar - 1e-9").groupBy("learner", "zone").agg(F.count("*").alias("sure")).where(F.col("sure") >= n)
    none = bar.where(F.col("level") == few).select("cell", "turn", "zone", "bar")
    rest = people.where(F.col("level") > few).join(sure, ["learner", "zone"], "left").join(F.broadcast(none), ["cell", "turn", "zone"], "left")
    unsure = F.col("sure").isNull() & F.col("bar").isNotNull()
    if strategy != "progressive":  # who has taken many of the first that are alike may need one that wasn't asked for
        alike = [*_ALIKE, *(["layer"] if strategy == "a_stratified" else [])]
        first = items.withColumn("twin", F.row_number().over(Window.partitionBy(*alike).orderBy("item"))).where(F.col("twin") <= 2**few)
        crowded = taken.join(first, "item").groupBy("learner", *alike).agg(F.count("*").alias("gone")).where(F.col("gone") > 2**few - n)
        rest = rest.join(crowded.select("learner", "zone", F.lit(True).alias("crowded")).distinct(), ["learner", "zone"], "left")
        unsure = unsure | F.col("crowded").isNotNull()
    rest = cut(rest.where(unsure).select(*people.columns))
    columns = ["learner", "item", "a", "b", "c", "area", "score", "rank"]
    if rest.isEmpty():
        return found.select(*columns)
    more, _ = _search(rest, items, taken, strategy, n)
    return found.join(rest.select("learner", "zone"), ["learner", "zone"], "left_anti").select(*columns).unionByName(more.select(*columns))


def _search(people: DataFrame, items: DataFrame, taken: DataFrame, strategy: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(learner, zone, item, a, b, c, area, score, rank, bar) of the n best of each learner's candidates, and the bars.

    people: learner, theta, turn, zone, level, cell. The 2**level first items of a cell that can't score below its bar
    make it; items that can't reach it aren't candidates. Where there are fewer items all are candidates and bar is null.
    """
    where, group = ["cell", "turn"], ["cell", "turn", "zone"]
    need = cut(people.groupBy(*group, "level").agg(F.lit(1).alias("one")).select(*group, "level", F.pow(F.lit(2), F.col("level")).cast("long").alias("k")))
    top = need.agg(F.max("k")).first()[0] or 0
    cells = need.groupBy().agg(F.array_sort(F.collect_set(F.struct(*where))).alias("cells"))  # a bounded number of cells in one row
    edge = F.lit(LOW) + F.col("cell") * WIDTH
    may, surely, least, most = _bounds(strategy)
    layers = ["layer"] if strategy == "a_stratified" else []
    if strategy != "progressive":  # of items that are alike only the first k can make a bar; more may stay below if taken
        alike = Window.partitionBy(*_ALIKE, *layers).orderBy("item")
        items = items.withColumn("twin", F.row_number().over(alike)).where(F.col("twin") <= top)
    spread = items.join(F.broadcast(cells)).withColumn("at", F.explode("cells")).select("item", "a", "b", "c", "area", "zone", *layers, "at.*")
    spread = spread.withColumn("t0", edge - 1e-9).withColumn("t1", edge + WIDTH + 1e-9)
    scored = cut(spread.where(may).select("item", "a", "b", "c", "area", *layers, *group, F.when(surely, least).alias("least"), most.alias("most")))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("least"), "item"))
    ranked = scored.where("least is not null").select(*group, "least", place.cast("long").alias("k"), "item").where(F.col("k") <= top)
    bar = ranked.join(F.broadcast(need), [*group, "k"]).groupBy(*group, "level").agg(F.max("least").alias("bar"))
    kept = scored.join(F.broadcast(need.select(*group, "level")), group).join(bar, [*group, "level"], "left").where("bar is null or most >= bar - 1e-8")
    part, score = _score(strategy)
    found = people.join(kept.drop("least", "most"), [*group, "level"]).where(part).join(taken.select("learner", "item"), ["learner", "item"], "left_anti")
    found = found.select("learner", "zone", "item", "a", "b", "c", "area", F.round(score, DIGITS).alias("score"), "bar")
    rank = F.row_number().over(Window.partitionBy("learner", "zone").orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n), bar


def allowed(items: DataFrame, taken: DataFrame, targets: dict[str, float] | None = None, exposure: float | None = None) -> DataFrame:
    """items without those of areas that have reached their target share of what was taken in areas with a target, and
    without items whose share of all that was taken has reached exposure. Nothing taken: nothing is held back."""
    held = items
    chosen = taken.join(items.select("item", "area"), "item")
    if targets:
        in_areas = chosen.where(F.col("area").isin(*targets)).groupBy("area").agg(F.count("*").alias("n"))
        shares = in_areas.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row for each target
        full = shares.where(F.col("share") >= F.element_at(F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)), F.col("area")) - 1e-9)
        held = held.join(F.broadcast(full.select("area")), "area", "left_anti")
    if exposure is not None:
        total = chosen.agg(F.count("*").alias("total"))
        worn = chosen.groupBy("item").agg(F.count("*").alias("n")).join(F.broadcast(total)).where(F.col("n") >= exposure * F.col("total"))
        held = held.join(worn.select("item"), "item", "left_anti")
    return held.select(*items.columns)


#: What a strategy searches for; a later search is for those whom the ones before it offer nothing.
_SEARCHES = {"zpd_aware": ("zpd_aware", "solvable", "b_match"), "randomesque": ("fisher_info",), "progressive": ("progressive", "fisher_info"), "a_stratified": ("a_stratified", "fisher_info"), "bkt_irt_fusion": ("by_area",)}
#: The turn from which information alone counts in the progressive strategy.
_INFORMED = math.ceil(1 / (ERROR * ERROR) - 1e-9)
#: Learners that share a copy of their cell's candidates.
_SHARE = 20_000


def select_next(learners: DataFrame, items: DataFrame, taken: DataFrame, strategy: str, mastery: DataFrame | None = None) -> DataFrame:
    """(learner, item, score) of each learner's next item by one of STRATEGIES; learners that have taken all have none.

    zpd_aware falls back to the item nearest in difficulty, first among those that aren't too hard. a_stratified falls
    back to the whole bank. bkt_irt_fusion takes mastery (learner, area, p): areas in the middle range, or unknown, first.
    """
    return select_each(learners, items, taken, (strategy,), mastery).drop("strategy")


def select_each(learners: DataFrame, items: DataFrame, taken: DataFrame, strategies: tuple[str, ...] = STRATEGIES, mastery: DataFrame | None = None) -> DataFrame:
    """(learner, strategy, item, score): select_next by several strategies at once.

    What learners have taken is gathered once, a row for each. The candidates of a cell come to its learners in tasks, which
    score them in blocks; so what grows with learners times candidates is never a row. Whoever isn't sure of the best
    asks again for as many candidates as that takes.
    """
    for strategy in strategies:
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy}; known are {', '.join(STRATEGIES)}")
    items = items.dropDuplicates(["item"]).where("item is not null and a > 0 and b is not null and c >= 0 and c < 1")
    items = items.select("item", *(F.col(x).cast("double").alias(x) for x in ("a", "b", "c")), F.coalesce(F.concat(F.lit("="), F.col("area").cast("string")), F.lit("")).alias("area"))
    items = cut(with_layer(items))
    searches = tuple(dict.fromkeys(s for k in strategies for s in _SEARCHES.get(k, (k,))))
    drawn = DRAWN if "randomesque" in strategies else 1
    gone = taken.join(items.select("item"), "item", "left_semi").groupBy("learner").agg(F.collect_set("item").alias("taken"))
    people = learners.select("learner", "theta").dropDuplicates(["learner"]).where("theta is not null and not isnan(theta)").join(gone, "learner", "left")
    if mastery is None or "bkt_irt_fusion" not in strategies:
        people = people.withColumn("outside", F.array().cast("array<string>"))
    else:
        known = mastery.where("area is not null and p is not null").where(~F.col("p").between(MASTERY_LOW, MASTERY_HIGH))
        known = known.groupBy("learner").agg(F.collect_set(F.concat(F.lit("="), F.col("area").cast("string"))).alias("outside"))
        people = people.join(known, "learner", "left")
    n = F.when(F.col("taken").isNull(), 0).otherwise(F.size("taken"))
    theta = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("theta")))
    people = cut(people.select("learner", theta.cast("double").alias("theta"), n.alias("n"), draw(F.col("learner"), n).alias("draw"), "taken", "outside", _cell(theta).alias("cell")))
    first = cut(_chosen(people.withColumn("level", F.lit(0)), items, strategies, searches, drawn, last=False))
    unsure = first.where("strategy is null").select(F.col("learner").alias("who"))
    found = first.where("strategy is not null")
    if unsure.isEmpty():
        return found
    again = people.join(unsure, F.col("learner").eqNullSafe(F.col("who")), "left_semi")
    level = F.ceil(F.log2(F.col("n") + F.lit(float(drawn)))).cast("int")
    return found.unionByName(_chosen(again.withColumn("level", level), items, strategies, searches, drawn, last=True))


def _chosen(people: DataFrame, items: DataFrame, strategies: tuple[str, ...], searches: tuple[str, ...], drawn: int, last: bool) -> DataFrame:
    """What people choose, each from 2**level candidates and those that may be as good, or from a few if it isn't the last time."""
    spark = people.sparkSession
    informed, third = F.least("n", F.lit(_INFORMED)), layer(F.least(F.col("n"), F.lit(LENGTH)))
    asked = cut(people.groupBy("cell", "level", informed.alias("informed"), third.alias("third")).agg(F.count("*").alias("people")))  # at most some thousand rows
    wanted = None
    for number, search in enumerate(searches):
        n = drawn if search == "fisher_info" else 1
        turn = {"progressive": F.col("informed"), "a_stratified": F.col("third")}.get(search, F.lit(0))
        k = F.pow(F.lit(2), F.col("level")) if last else F.lit(2 ** math.ceil(math.log2(4 * n)))
        need = asked.select("cell", "level", turn.cast("int").alias("turn"), k.cast("long").alias("k"))
        if search == "progressive":
            need = need.where(F.col("turn") < _INFORMED)
        need = need.distinct().collect()
        if need:
            c = _candidates(spark.createDataFrame(need, "cell int, level int, turn int, k long"), max(r.k for r in need), items, search)
            c = c.withColumn("search", F.lit(number))
            wanted = c if wanted is None else wanted.unionByName(c)
    kind = items.schema["item"].dataType
    names = ["cell", "level", "part", "kind", "search", "turn", "zone", "item", "a", "b", "c", "r", "w", "k", "bar", "learner", "theta", "n", "draw", "taken", "outside"]
    parts = F.broadcast(asked.groupBy("cell", "level").agg(F.ceil(F.sum("people") / F.lit(_SHARE)).cast("int").alias("parts")))
    own = people.join(parts, ["cell", "level"]).withColumn("part", F.pmod(F.xxhash64("learner"), F.col("parts")).cast("int"))
    whole = lambda df, number: df.withColumn("kind", F.lit(number))
    own = whole(own.drop("parts"), 1)
    rows = own
    if wanted is not None:
        wanted = whole(wanted.join(parts, ["cell", "level"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), 0)
        rows = wanted.unionByName(own, allowMissingColumns=True).select(*names)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        rows = rows.repartition(tasks, "cell", "level", "part").sortWithinPartitions("cell", "level", "part", "kind", "search", "turn", "zone", "item")
    values = {"HARD": HARD, "EASY": EASY, "DELTA": DELTA, "FUSION": FUSION, "UNIT": 10.0**DIGITS, "INFORMED": _INFORMED, "LENGTH": LENGTH, "LAST": last}
    schema = f"learner {people.schema['learner'].dataType.simpleString()}, strategy string, item {kind.simpleString()}, score double"
    return rows.mapInArrow(lambda batches: chosen(batches, strategies, searches, drawn, values), schema)


def _candidates(need: DataFrame, top: int, items: DataFrame, search: str) -> DataFrame:
    """(cell, level, turn, zone, item, a, b, c, r, w, k, bar): items that may be among the k best of the learners of a cell.

    need: cell, level, turn, k, a small local frame. The k first items of a cell that can't score below its bar make it;
    items that can't reach it aren't candidates. Where there are fewer items all are candidates and bar is null.
    """
    strategy = "fisher_info" if search == "by_area" else search
    group, need = ["cell", "turn", "zone"], F.broadcast(need)
    where = F.broadcast(need.select("cell", "turn").distinct())
    may, surely, least, most = _bounds(strategy)
    items = items.withColumn("zone", F.col("area") if search == "by_area" else F.lit(""))
    alike = ["b"] if search == "b_match" else [*_ALIKE, *(["layer"] if search == "a_stratified" else [])]
    if search == "progressive":  # of items that are alike those of the greatest draws of a turn, as near as scores are compared
        items = items.join(F.broadcast(need.select("turn").distinct())).withColumn("r", draw(F.col("item"), F.col("turn")))
        same = Window.partitionBy("turn", *alike)
        items = items.withColumn("twin", F.row_number().over(same.orderBy(F.desc("r")))).withColumn("least_r", F.max(F.when(F.col("twin") == top, F.col("r"))).over(same))
        items = items.where("least_r is null or r >= least_r - 2e-7").drop("twin", "least_r")
        spread = items.join(where, "turn")
    else:  # of items that are alike only the first k can make a bar; more may stay below if taken
        items = items.withColumn("twin", F.row_number().over(Window.partitionBy(*alike).orderBy("item"))).where(F.col("twin") <= top).drop("twin")
        spread = items.withColumn("r", F.lit(0.0)).join(where, items["layer"] == where["turn"]) if search == "a_stratified" else items.withColumn("r", F.lit(0.0)).crossJoin(where)
    edge = F.lit(LOW) + F.col("cell") * WIDTH
    spread = spread.withColumn("t0", edge - 1e-9).withColumn("t1", edge + WIDTH + 1e-9)
    scored = cut(spread.where(may).select("item", "a", "b", "c", "r", *group, F.when(surely, least).alias("least"), most.alias("most")))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("least")))
    ranked = scored.where("least is not null").select(*group, "least").withColumn("k", place.cast("long")).where(F.col("k") <= top)
    bar = ranked.join(need, ["cell", "turn", "k"]).select(*group, "level", F.col("least").alias("bar"))
    kept = scored.join(need, ["cell", "turn"]).join(bar, [*group, "level"], "left").where("bar is null or most >= bar - 1e-8")
    w = share(F.col("turn")) if search == "progressive" else F.lit(1.0)
    return kept.select("cell", "level", "turn", "zone", "item", "a", "b", "c", "r", w.cast("double").alias("w"), "k", "bar")


def stop_rules(learners: DataFrame, items: DataFrame, taken: DataFrame, least: int = 5, most: int = LENGTH, error: float = ERROR, width: float = 0.5, z: float = 1.959963984540054, bar: float = 0.0, sure_z: float = 1.6448536269514722, low_gain: float = 0.01, high_gain: float = 0.05) -> DataFrame:
    """(learner, theta, se, n, gain, by_length, by_error, by_width, by_class, by_gain): which rules end a learner's test.

    learners: learner, theta, se, n. gain is what the most informative item left would take off the error (null: none is
    left, which ends the test). by_gain ends it if that is at most high_gain once the error is reached, or below low_gain
    before. by_class tells that the ability lies on one side of bar with the confidence that sure_z stands for.
    """
    best = best_items(learners, items, taken, "fisher_info").select("learner", F.col("score").alias("info"))
    d = learners.join(best, "learner", "left").withColumn("gain", F.col("se") - 1 / F.sqrt(1 / (F.col("se") * F.col("se")) + F.col("info")))
    enough, end = F.col("n") >= least, F.col("n") >= most
    gained = F.when(F.col("gain").isNull(), True).when(F.col("se") < error, F.col("gain") <= high_gain).otherwise(F.col("gain") < low_gain)
    return d.select(
        "learner", "theta", "se", "n", "gain", end.alias("by_length"), (end | enough & (F.col("se") < error)).alias("by_error"),
        (end | enough & (2 * z * F.col("se") < width)).alias("by_width"), (F.abs(F.col("theta") - bar) > sure_z * F.col("se")).alias("by_class"), (end | enough & gained).alias("by_gain"),
    )
