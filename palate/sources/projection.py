"""The recommendation schema as views over the star-schema tables: orders are lists, parts are titles, events are logs.

Every view is a lazy DataFrame; filters and column choices reach the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import ship_package

#: All time-dependent queries on these tables look back from here; logs from there.
AS_OF = datetime(2002, 1, 1)
LOGS_AS_OF = datetime(2024, 1, 31)
# Part types as formats, and relation types with the type of their inverse.
FORMATS = {"STANDARD": "tv", "LARGE": "movie", "MEDIUM": "ona", "SMALL": "ova", "ECONOMY": "special", "PROMO": "music"}
INVERSE = {"sequel": "prequel", "prequel": "sequel", "side_story": "parent_story", "parent_story": "side_story", "spin_off": "other", "summary": "full_story", "full_story": "summary", "alternative_version": "alternative_version", "alternative_setting": "alternative_setting", "other": "other", "character": "character"}


def case_map(column: str, mapping: dict[str, str], default: str | None = None):
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        ship_package(self.spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def list_entry(self) -> DataFrame:
        """(user_id, item_id, score, status, rated_at): the newest line of each user and part. One shuffle on the pair after a partial maximum."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
        orders = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
        score = F.when(F.col("l_returnflag") == "N", F.lit(0)).otherwise(F.ceil(F.col("l_quantity") / 5).cast("int"))
        status = (
            F.when((F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")), "completed")
            .when(F.col("l_returnflag") == "R", "dropped").when(F.col("l_linestatus") == "F", "on_hold").otherwise("plan_to_watch")
        )
        newest = lines.join(orders, "l_orderkey").groupBy("user_id", F.col("l_partkey").alias("item_id")).agg(
            F.max(F.struct(F.col("l_shipdate").alias("rated_at"), "l_orderkey", "l_linenumber", score.alias("score"), status.alias("status"))).alias("e")
        )
        return newest.select("user_id", "item_id", "e.score", "e.status", "e.rated_at")

    @cached_property
    def rated(self) -> DataFrame:
        return self.list_entry.filter("score > 0")

    @cached_property
    def item(self) -> DataFrame:
        """Static facts of each title."""
        start = F.make_date(1960 + F.col("p_size"), (F.col("p_partkey") % 12 + 1).cast("int"), F.lit(1))
        return self.read("part").select(
            F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("studio"), case_map("p_type", FORMATS).alias("media_type"),
            F.split("p_name", " ").alias("genres"), (1960 + F.col("p_size")).alias("season_year"), F.col("p_size").alias("num_episodes"), start.alias("start_date"),
            F.when(start <= F.lit(AS_OF).cast("date"), "finished_airing").otherwise("not_yet_aired").alias("status"), F.when(F.col("p_partkey") % 13 == 0, "black").otherwise("white").alias("nsfw"),
        )

    @cached_property
    def item_stats(self) -> DataFrame:
        """(item_id, members, scorers, mean, popularity): audience and rank of every listed title."""
        stats = self.list_entry.groupBy("item_id").agg(F.count("*").alias("members"), F.count_if(F.col("score") > 0).alias("scorers"), F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("mean"))
        rank = F.row_number().over(Window.orderBy(F.desc("members"), "item_id"))  # one row a title: the catalogue, not the lists
        return stats.withColumn("popularity", rank)

    @cached_property
    def relation(self) -> DataFrame:
        """(src, dst, relation_type): dst is src's sequel (or side story, spin-off); the inverse links are stored too."""
        after = F.lead("p_partkey").over(Window.partitionBy("p_brand", F.col("p_partkey") % 6).orderBy("p_partkey"))
        links = self.read("part").select(F.col("p_partkey").alias("src"), after.alias("dst")).filter("dst is not null")
        kind = F.when(F.col("dst") % 5 == 0, "side_story").when(F.col("dst") % 7 == 0, "spin_off").otherwise("sequel")
        links = links.withColumn("relation_type", kind)
        return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), case_map("relation_type", INVERSE).alias("relation_type")))

    @cached_property
    def prequel(self) -> DataFrame:
        return self.relation.filter("relation_type = 'prequel'").select(F.col("src").alias("item_id"), F.col("dst").alias("prequel_id"))

    @cached_property
    def rec_edge(self) -> DataFrame:
        """(src, dst, votes, weight): parts of one order recommend one another; weight sqrt(v) * v / total of the source."""
        lines = self.read("lineitem").select("l_orderkey", F.col("l_partkey").alias("p")).distinct()
        votes = lines.select("l_orderkey", F.col("p").alias("src")).join(lines.select("l_orderkey", F.col("p").alias("dst")), "l_orderkey").filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("votes"))
        total = votes.groupBy("src").agg(F.sum("votes").alias("total"))
        return votes.join(total, "src").select("src", "dst", "votes", (F.sqrt("votes") * F.col("votes") / F.col("total")).alias("weight"))

    @cached_property
    def item_staff(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("staff_id")).distinct()

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("item_id"))

    @cached_property
    def feedback(self) -> DataFrame:
        """(user_id, item_id, action, created_at)"""
        action = F.when(F.col("event_type") == "error", "not_interested").when(F.col("event_type") == "purchase", "queued")
        return self.events.withColumn("action", action).filter("action is not null").select("user_id", "item_id", "action", F.col("ts").alias("created_at"))

    @cached_property
    def rec_log(self) -> DataFrame:
        """(log_id, user_id, surface, item_id, rank, predicted, shown_at)"""
        return self.events.filter("event_type = 'view'").select(
            F.col("event_id").alias("log_id"), "user_id", F.when(F.col("item_id") % 2 == 0, "safe_bets").otherwise("discover").alias("surface"), "item_id", (F.col("item_id") % 50 + 1).alias("rank"), F.col("value").alias("predicted"), F.col("ts").alias("shown_at")
        )

    @cached_property
    def list_event(self) -> DataFrame:
        """(user_id, item_id, status, score, at): the log of list changes."""
        status = F.element_at(F.array(*map(F.lit, ("plan_to_watch", "watching", "completed", "dropped"))), (F.col("item_id") % 4 + 1).cast("int"))
        return self.events.filter("event_type in ('click', 'signup')").select("user_id", "item_id", status.alias("status"), (F.col("event_id") % 11).cast("int").alias("score"), F.col("ts").alias("at"))

    @cached_property
    def tag_vector(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")
