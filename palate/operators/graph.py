"""Graphs of titles: prequel closure, connected components, series and franchises, explanations along edges.

Loops exchange small edge tables, each cut with checkpoint() in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import checkpointed, discard, staged_at

# Relation types by kind, in order of priority.
KINDS = (
    ("chain", ("sequel", "prequel")),
    ("world", ("spin_off", "alternative_setting")),
    ("retold", ("alternative_version",)),
    ("attach", ("side_story", "parent_story", "summary", "full_story")),
)
SERIES_LINKS, FRANCHISE_LINKS = ("attach",), ("attach", "world")


def prequel_closure(prequel: DataFrame, max_depth: int = 12) -> DataFrame:
    """(item_id, prequel_id, depth): all transitive prequels, each at its least depth; a title is never its own."""
    step = checkpointed(prequel.select("item_id", "prequel_id").filter("item_id <> prequel_id").distinct())
    reached, front = step.withColumn("depth", F.lit(1)), step
    for depth in range(2, max_depth + 1):
        ahead = front.join(step.select(F.col("item_id").alias("prequel_id"), F.col("prequel_id").alias("next")), "prequel_id").select("item_id", F.col("next").alias("prequel_id")).filter("item_id <> prequel_id").distinct()
        front = checkpointed(ahead.join(reached.select("item_id", "prequel_id"), ["item_id", "prequel_id"], "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front.withColumn("depth", F.lit(depth)))
    return reached


def unmet_prequels(pairs: DataFrame, closure: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """(user_id, item_id, prequel_id): required prequels (main formats) that the user has not completed, for (user_id, item_id) pairs."""
    from ..functions.scalars import format_class

    main = items.filter(format_class("media_type") == "main").select(F.col("item_id").alias("prequel_id"))
    need = pairs.select("user_id", "item_id").join(closure.join(main, "prequel_id", "left_semi"), "item_id").select("user_id", "item_id", "prequel_id")
    done = entries.filter("status = 'completed'").select("user_id", F.col("item_id").alias("prequel_id"))
    return need.join(done, ["user_id", "prequel_id"], "left_anti")


def satisfied(pairs: DataFrame, closure: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """The (user_id, item_id) pairs whose main-format prequels are all completed."""
    return pairs.join(unmet_prequels(pairs, closure, items, entries), ["user_id", "item_id"], "left_anti")


def requirements(closure: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, required): how many main-format prequels a title has; titles without are absent."""
    from ..functions.scalars import format_class

    main = items.filter(format_class("media_type") == "main").select(F.col("item_id").alias("prequel_id"))
    return closure.join(main, "prequel_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("required"))


def opened(closure: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """(user_id, item_id): titles with requirements whose prequels a user has all completed.

    Found from what users completed, a few titles each, and never by asking every user about every title.
    """
    from ..functions.scalars import format_class

    main = items.filter(format_class("media_type") == "main").select(F.col("item_id").alias("prequel_id"))
    done = entries.filter("status = 'completed'").select("user_id", F.col("item_id").alias("prequel_id"))
    met = done.join(closure.join(main, "prequel_id", "left_semi").select("item_id", "prequel_id"), "prequel_id").groupBy("user_id", "item_id").agg(F.count("*").alias("met"))
    return met.join(requirements(closure, items), "item_id").filter("met = required").select("user_id", "item_id")


#: Titles opened for a user up to which they are looked through for each title, not hashed.
FEW_OPENED = 64


def pool_exclusions(entries: DataFrame, prequel: DataFrame, closure: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id): titles with unmet prequels, and direct sequels of completed titles that the user liked.

    Unmet are all titles with requirements but those that are opened for the user. Their ids come to each user as one array and are laid
    out there; the result is nearly users x such titles, and none of it is shuffled. Sequels come in addition where they are not unmet.
    """
    opened_ = checkpointed(opened(closure, items, entries))
    need = checkpointed(requirements(closure, items).select("item_id"))
    mine = opened_.groupBy("user_id").agg(F.collect_set("item_id").alias("opened"))
    users = entries.select("user_id").distinct().join(mine, "user_id", "left").withColumn("opened", F.coalesce("opened", F.array().cast("array<long>")))
    few = F.size("opened") <= FEW_OPENED
    left = users.crossJoin(F.broadcast(need.agg(F.collect_list("item_id").alias("needy"))))  # one row
    unmet = left.select("user_id", "opened", F.explode(F.when(few, F.col("needy")).otherwise(F.array_except("needy", "opened"))).alias("item_id")).filter(~(few & F.array_contains("opened", F.col("item_id")))).select("user_id", "item_id")
    bar = entries.filter("score > 0").groupBy("user_id").agg(F.greatest(F.bround(F.avg("score")) - 1, F.lit(6)).alias("bar"))
    liked = entries.filter("status = 'completed'").join(bar, "user_id").filter(F.col("score") >= F.col("bar")).select("user_id", F.col("item_id").alias("prequel_id"))
    after = checkpointed(liked.join(prequel, "prequel_id").select("user_id", "item_id").distinct())
    return unmet.unionByName(after.join(need, "item_id", "left_anti").select("user_id", "item_id")).unionByName(after.join(opened_, ["user_id", "item_id"], "left_semi"))


def pair_kinds(relation: DataFrame) -> DataFrame:
    """(a, b, kind): unordered pairs with their strongest kind."""
    rank = F.lit(None).cast("int")
    for k, (_, types) in enumerate(KINDS):
        rank = F.when(F.col("relation_type").isin(*types), F.lit(k)).otherwise(rank)
    pairs = relation.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), rank.alias("rank")).filter("rank is not null").groupBy("a", "b").agg(F.min("rank").alias("rank"))
    return pairs.select("a", "b", F.element_at(F.array(*(F.lit(k) for k, _ in KINDS)), F.col("rank") + 1).alias("kind"))


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reached. Each round takes the least label of the neighbours and then jumps to that label's own label."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpointed(nodes.select("node").unionByName(both.select(F.col("a").alias("node"))).distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = checkpointed(step.join(jump, "next", "left").select("node", F.col("component").alias("was"), F.least("next", F.coalesce("far", "next")).alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def story_groups(nodes: DataFrame, relation: DataFrame, hanging: tuple[str, ...], max_rounds: int = 1000) -> DataFrame:
    """(item_id, group_id): what chains and retellings join, and what hangs off it; group_id is the smallest member.

    A hanging link only ever joins a group to a larger one (by members, then the smaller id). Groups take turns, the smallest of the
    start of a pass first. In its turn a group looks at its larger neighbours: it joins the only one; a single title with several
    joins the largest; another group with several stays alone; either way the links looked at are given up. Passes go on while groups
    join. ``hung`` gives the outcome of these turns one by one, in rounds that act for all groups that need not wait.
    """
    kinds = pair_kinds(relation)
    joined = connected_components(nodes.select(F.col("item_id").alias("node")), kinds.filter(F.col("kind").isin("chain", "retold")).select("a", "b"))
    of = checkpointed(joined.select(F.col("node").alias("item_id"), F.col("component").alias("group_id")))
    links = kinds.filter(F.col("kind").isin(*hanging)).select("a", "b")
    at = of.select(F.col("item_id").alias("a"), F.col("group_id").alias("ga")), of.select(F.col("item_id").alias("b"), F.col("group_id").alias("gb"))
    links = links.join(at[0], "a").join(at[1], "b").select("ga", "gb")
    into = hung(of.groupBy("group_id").agg(F.count("*").alias("n")), links, max_rounds)
    return of.join(into, "group_id", "left").select("item_id", F.coalesce("into", "group_id").alias("group_id"))


def hung(groups: DataFrame, links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(group_id, into): the groups with links and what each is in at the end, by the turns that ``story_groups`` describes.

    groups: (group_id, n); links: (ga, gb). ``turn`` is a group's place in a pass: its size and id at the start of the pass. A group's
    act depends on its links and on the sizes of its neighbours, so it waits for an earlier turn at one or two links' distance, which
    could give it members or make a neighbour grow. At two links it need not wait where both groups are *settled*: no neighbour has an
    earlier turn, all neighbours are larger, and it is known whether to join the only one or to stay alone, as sizes only grow. So the
    many titles that hang off one large group act in one round; titles that hang off several take turns where these groups are shared,
    which is what the number of rounds grows with. The tables exchanged are the groups with links. They are written and read back: the
    constraints that a checkpoint keeps for the optimizer would double with each round.
    """
    links = _both_ways(links)
    linked = links.select(F.col("ga").alias("group_id")).distinct()
    state = groups.join(linked, "group_id", "left_semi").select(F.col("group_id").alias("g"), "n")
    part = state.select(F.col("g").alias("group_id"), F.col("g").alias("into"))
    mine, theirs = _place("n", "g"), _place("nb", "gb")
    turn_of = "struct<n:bigint,id:bigint>"
    state, joined, paths = state.withColumn("turn", mine.cast(turn_of)), False, {}

    def carried(name: str, df: DataFrame) -> DataFrame:
        """The table of the next round in the place of the last one's."""
        out, path = staged_at(df)
        old.append(paths.get(name))
        paths[name] = path
        return out

    old: list[str | None] = []
    state, part = carried("state", state), carried("part", part)
    for _ in range(max_rounds):
        near = links.join(state.select(F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("turn").alias("tb")), "gb")
        near = near.join(state.withColumnRenamed("g", "ga"), "ga").withColumn("up", theirs > _place("n", "ga"))
        view = near.groupBy(F.col("ga").alias("g")).agg(
            F.first("n").alias("n"), F.first("turn").alias("turn"), F.min("tb").alias("next"), F.count("*").alias("near"), F.count_if("up").alias("ups"), F.max(F.when(F.col("up"), theirs)).alias("most"),
        )
        settled = (F.col("next").isNull() | (F.col("turn") < F.col("next"))) & (F.col("ups") == F.col("near")) & ((F.col("near") == 1) | (F.col("n") > 1))
        view = checkpointed(view.withColumn("settled", F.coalesce(settled, F.lit(False))).withColumn("open", F.when(~F.col("settled"), F.col("turn"))))
        if view.isEmpty():
            break
        # the earliest turn, and the earliest of an unsettled group, within one link and then within two
        at = view.select(F.col("g").alias("gb"), F.col("turn").alias("tb"), F.col("open").alias("ob"))
        one = links.join(at, "gb").groupBy("ga").agg(F.min("tb").alias("t1"), F.min("ob").alias("o1"))
        own = view.select(F.col("g").alias("ga"), F.col("turn"), F.col("open")).join(one, "ga").select(F.col("ga").alias("gb"), F.least("turn", "t1").alias("t1"), F.least("open", "o1").alias("o1"))
        two = links.join(own, "gb").groupBy(F.col("ga").alias("g")).agg(F.min("t1").alias("first"), F.min("o1").alias("first_open"))
        free = (F.col("turn") == F.col("first")) | (F.col("settled") & (F.col("first_open").isNull() | (F.col("turn") < F.col("first_open"))))
        acting = view.join(two, "g").filter(F.col("turn").isNotNull() & free)
        acting = checkpointed(acting.select("g", F.when((F.col("ups") == 1) | ((F.col("n") == 1) & (F.col("ups") > 0)), -F.col("most.id")).alias("to")))
        if acting.isEmpty():
            if not joined:
                break
            # the next pass: every group has a turn again
            state, joined = state.withColumn("turn", mine.cast(turn_of)), False
            continue
        # what acted has had its turn and gives up its links to larger groups
        acted = acting.select(F.col("g").alias("ga"), F.lit(True).alias("acted"))
        low = near.filter("up").join(acted, "ga", "left_semi").select("ga", "gb")
        links = links.join(low, ["ga", "gb"], "left_anti").join(low.select(F.col("gb").alias("ga"), F.col("ga").alias("gb")), ["ga", "gb"], "left_anti")
        moved = acting.filter("to is not null")
        state = state.join(acting.select("g", F.lit(True).alias("acted")), "g", "left").withColumn("turn", F.when(F.col("acted").isNull(), F.col("turn"))).drop("acted")
        if not moved.isEmpty():
            joined = True
            sizes = moved.join(state.select("g", "n"), "g").groupBy("to").agg(F.min("g").alias("least"), F.sum("n").alias("more"))
            name = checkpointed(sizes.select("to", F.least("to", "least").alias("now"), "more"))
            renamed = moved.join(name.select("to", "now"), "to").select("g", "now").unionByName(name.select(F.col("to").alias("g"), "now"))
            grown = state.join(moved.select("g"), "g", "left_anti").join(name.withColumnRenamed("to", "g"), "g", "left")
            state = grown.select(F.coalesce("now", "g").alias("g"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "turn")
            part = carried("part", part.join(renamed.withColumnRenamed("g", "into"), "into", "left").select("group_id", F.coalesce("now", "into").alias("into")))
            to = renamed.withColumnRenamed("g", "ga").withColumnRenamed("now", "na"), renamed.withColumnRenamed("g", "gb").withColumnRenamed("now", "nb")
            links = links.join(to[0], "ga", "left").join(to[1], "gb", "left").select(F.coalesce("na", "ga").alias("ga"), F.coalesce("nb", "gb").alias("gb")).filter("ga <> gb").distinct()
        state, links = carried("state", state), carried("links", links)
        while old:
            discard(old.pop() or "")
    else:
        raise RuntimeError(f"groups not settled after {max_rounds} rounds")
    return part


def _both_ways(links: DataFrame) -> DataFrame:
    return checkpointed(links.unionByName(links.select(F.col("gb").alias("ga"), F.col("ga").alias("gb"))).filter("ga <> gb").distinct())


def _place(n: str, g: str):
    """Larger groups, then smaller ids, come last."""
    return F.struct(F.col(n).cast("long").alias("n"), (-F.col(g)).cast("long").alias("id"))


def series_and_franchise(nodes: DataFrame, relation: DataFrame) -> DataFrame:
    """(item_id, series_id, franchise_id)"""
    series = story_groups(nodes, relation, SERIES_LINKS).withColumnRenamed("group_id", "series_id")
    return series.join(story_groups(nodes, relation, FRANCHISE_LINKS).withColumnRenamed("group_id", "franchise_id"), "item_id")


def shared_series(series: DataFrame) -> DataFrame:
    """Only the series of more than one title."""
    many = series.groupBy("series_id").count().filter("count > 1").select("series_id")
    return series.join(many, "series_id", "left_semi").select("item_id", "series_id")


def edge_reasons(picks: DataFrame, dev: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """(user_id, item_id, rank, because_id, strength): the rated titles that speak most for a pick along recommendation edges."""
    best = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    at = picks.select("user_id", F.col("item_id").alias("src")).join(best, "src").join(dev.select("user_id", F.col("item_id").alias("dst"), "d"), ["user_id", "dst"])
    at = at.select("user_id", F.col("src").alias("item_id"), F.col("dst").alias("because_id"), (F.col("weight") * F.col("d")).alias("strength")).filter("strength > 0")
    rank = F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy(F.desc("strength"), "because_id"))
    return at.withColumn("rank", rank).filter(F.col("rank") <= top)


