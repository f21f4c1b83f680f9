"""Catalogue and list payloads: JSON files as two public list services return them, read with a schema and flattened.

There is no network here; the files hold the services' own documents, so a fetcher only has to drop them into a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

NODE = "id long, title string, alternative_titles struct<en: string, synonyms: array<string>>, media_type string, status string, start_date string, end_date string, num_episodes int, mean double, popularity int, num_list_users long, num_scoring_users long, nsfw string, genres array<struct<id: int, name: string>>, studios array<struct<id: int, name: string>>, start_season struct<year: int, season: string>, related_anime array<struct<node: struct<id: long, title: string>, relation_type: string>>, recommendations array<struct<node: struct<id: long, title: string>, num_recommendations: int>>, statistics struct<status: map<string, string>, num_list_users: long>"
MEDIA = "id long, idMal long, averageScore int, favourites int, tags array<struct<name: string, rank: int, isAdult: boolean>>, staff struct<edges: array<struct<role: string, node: struct<id: long>>>>, stats struct<scoreDistribution: array<struct<score: int, amount: long>>, statusDistribution: array<struct<status: string, amount: long>>>"
LIST_ROW = f"user_id long, page int, error string, paging struct<next: string>, data array<struct<node: struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in ('id long', 'title string'))}>, list_status: struct<status: string, score: int, num_episodes_watched: int, finish_date: string, updated_at: timestamp>>>"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).json(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEDIA).json(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIST_ROW).json(path)


def item_rows(nodes: DataFrame) -> DataFrame:
    """One flat row a title."""
    return nodes.select(
        F.col("id").alias("item_id"), "title", F.col("alternative_titles.en").alias("title_en"), "media_type", "status", S.whole_date("start_date").alias("start_date"), S.whole_date("end_date").alias("end_date"), F.nullif("num_episodes", F.lit(0)).alias("num_episodes"),
        "mean", "popularity", F.col("num_list_users").alias("members"), F.col("num_scoring_users").alias("scorers"), "nsfw", F.transform(F.coalesce("genres", F.array()), lambda g: g["name"]).alias("genres"), F.transform(F.coalesce("studios", F.array()), lambda g: g["name"]).alias("studios"),
        F.col("start_season.year").alias("season_year"), F.col("start_season.season").alias("season"), S.drop_rate(F.col("statistics.status")["dropped"].cast("long"), F.aggregate(F.map_values("statistics.status"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))).alias("drop_rate"),
    )


def whole_lists(pages: DataFrame) -> DataFrame:
    """The pages of those users whose lists came whole: pages 0, 1, ... without a gap, none with an error, and only the last without a next
    one. A user who lacks a page keeps what is stored, so part of a list never passes for a shorter list. Of a page that was fetched
    twice any one is taken."""
    one = pages.dropDuplicates(["user_id", "page"])
    last = F.coalesce("paging.next", F.lit("")) == ""
    seen = one.groupBy("user_id").agg(F.count("page").alias("n"), F.count("*").alias("of"), F.max("page").alias("top"), F.min("page").alias("low"), F.count_if(last).alias("ends"), F.max(F.when(last, F.col("page"))).alias("end"), F.count("error").alias("errors"))
    whole = seen.filter("errors = 0 and n = of and low = 0 and top = n - 1 and ends = 1 and end = top").select("user_id")
    return one.join(whole, "user_id", "left_semi")


def list_rows(lists: DataFrame) -> DataFrame:
    """(user_id, item_id, status, score, episodes, finished_at, rated_at)"""
    e = lists.select("user_id", F.explode("data").alias("e"))
    return e.select("user_id", F.col("e.node.id").alias("item_id"), "e.list_status.status", F.coalesce("e.list_status.score", F.lit(0)).alias("score"), F.col("e.list_status.num_episodes_watched").alias("episodes"), S.whole_date("e.list_status.finish_date").alias("finished_at"), F.coalesce(S.whole_date("e.list_status.finish_date").cast("timestamp"), F.col("e.list_status.updated_at")).alias("rated_at"))


def media_rows(media: DataFrame, least_started: int = 50) -> DataFrame:
    """Second-source columns of a title: score, favourites, distribution and its spread, drop rate."""
    dist = F.map_from_entries(F.transform("stats.scoreDistribution", lambda x: F.struct(x["score"].cast("string"), x["amount"])))
    by = F.map_from_entries(F.transform("stats.statusDistribution", lambda x: F.struct(x["status"], x["amount"])))
    n = lambda k: F.coalesce(F.try_element_at(by, F.lit(k)), F.lit(0).cast("long"))
    started = n("COMPLETED") + n("DROPPED") + n("CURRENT") + n("PAUSED")
    return media.select(F.col("idMal").alias("item_id"), F.col("id").alias("media_id"), F.col("averageScore").alias("score"), "favourites", dist.alias("distribution"), S.spread_of_counts(dist, 50).alias("score_sd"), S.drop_rate(n("DROPPED"), started, least_started).alias("drop_rate"))


def tag_rows(media: DataFrame, least_rank: int = 40) -> DataFrame:
    """(item_id, tag, rank) of tags that are strong enough and not adult."""
    t = media.select(F.col("idMal").alias("item_id"), F.explode("tags").alias("t"))
    return t.filter((F.col("t.rank") >= least_rank) & ~F.coalesce("t.isAdult", F.lit(False))).select("item_id", F.col("t.name").alias("tag"), "t.rank").distinct()


def staff_rows(media: DataFrame, roles: tuple[str, ...] = ("Director", "Series Composition", "Original Creator", "Script", "Music")) -> DataFrame:
    """(item_id, staff_id, role): the role is what stands before a bracket."""
    e = media.select(F.col("idMal").alias("item_id"), F.explode("staff.edges").alias("e")).select("item_id", F.col("e.node.id").alias("staff_id"), F.trim(F.split("e.role", r"\(")[0]).alias("role"))
    return e.filter(F.col("role").isin(*roles) & F.col("staff_id").isNotNull()).distinct()


def edge_rows(nodes: DataFrame, provider: str = "first") -> DataFrame:
    """(src, dst, provider, votes, weight): recommendations with votes; weight sqrt(v) * v / all votes of the source."""
    r = nodes.select(F.col("id").alias("src"), "recommendations", F.aggregate(F.coalesce("recommendations", F.array()), F.lit(0), lambda a, x: a + F.greatest(F.coalesce(x["num_recommendations"], F.lit(0)), F.lit(0))).alias("total"))
    r = r.select("src", "total", F.explode("recommendations").alias("x")).filter("x.num_recommendations > 0")
    v = F.col("x.num_recommendations")
    return r.select("src", F.col("x.node.id").alias("dst"), F.lit(provider).alias("provider"), v.alias("votes"), (F.sqrt(v) * v / F.greatest("total", F.lit(1))).alias("weight"))


def relation_rows(nodes: DataFrame, provider: str = "first") -> DataFrame:
    r = nodes.select(F.col("id").alias("src"), F.explode("related_anime").alias("x"))
    return r.select("src", F.col("x.node.id").alias("dst"), "x.relation_type", F.lit(provider).alias("provider")).distinct()


def stub_rows(nodes: DataFrame) -> DataFrame:
    """(item_id, title) of titles that are only mentioned: they come in as stubs and wait for their details."""
    every = nodes.select(F.explode(F.concat(F.transform(F.coalesce("related_anime", F.array()), lambda x: x["node"]), F.transform(F.coalesce("recommendations", F.array()), lambda x: x["node"]))).alias("n"))
    return every.select(F.col("n.id").alias("item_id"), F.col("n.title").alias("title")).dropDuplicates(["item_id"]).join(nodes.select(F.col("id").alias("item_id")), "item_id", "left_anti")


def unzipped(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Parallel arrays as rows: the key with the values at each place."""
    return rows.select(key, F.explode(F.arrays_zip(*columns)).alias("__z")).select(key, *(F.col(f"__z.{c}").alias(c) for c in columns))
